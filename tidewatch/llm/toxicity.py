"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, toxic ones among them, is the
unlabelled side. With the class prior p, the risk of a scorer is p times its loss on the
positives plus its loss as negatives on the unlabelled side, from which p times the loss of the
positives as negatives is taken off; a batch where that difference falls below zero pushes it
back up instead. The features are hashed byte 5-grams, once and at least twice in a text, whose
shares among positives and unlabelled texts differ significantly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import fold, map_texts, small_batches
from tidewatch.llm.grams import hashed, letter_bytes

#: Documented bounds of what the classifier is fitted on: texts of either side, and features.
POSITIVES, UNLABELLED, FEATURES = 2_000, 8_000, 1_024
GRAM, BITS = 5, 20
#: Parts of the hash range in which the counts of the sample are added up.
PARTS = 32
#: Least normal score by which a feature's shares must differ.
LEAST_Z = 5.0
#: Texts handled at once inside a task.
BATCH = 256


@dataclass
class Model:
    """A linear scorer over hashed features."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The feature of every hash, and which grams have one."""
        slot = np.full(2 << BITS, -1, np.int16)
        slot[self.hashes] = np.arange(len(self.hashes))
        return slot, (slot.reshape(-1, 2) >= 0).any(1)


def hashed_features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes, each pair once: a gram's hash doubled, plus 1 where it comes at least twice.

    ``wanted`` (by gram) leaves out grams of no use.
    """
    grams, row = hashed(*letter_bytes(texts), GRAM, BITS)
    if wanted is not None:
        on = wanted[grams]
        grams, row = grams[on], row[on]
    key, times = np.unique(row.astype(np.int64) << BITS | grams, return_counts=True)
    key = np.concatenate([key << 1, key[times > 1] << 1 | 1])
    return key >> BITS + 1, key & (2 << BITS) - 1


def text_features(texts: pa.Array, slot: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features, each pair once, of the features that the texts have, by row."""
    row, key = hashed_features(texts, wanted)
    found = slot[key]
    row, found = row[found >= 0], found[found >= 0]
    order = np.argsort(row, kind="stable")
    return row[order], found[order]


def sampled(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """Texts of the training sample with their side (1: positive), and the class prior.

    Ids enter by their hash, so a sample does not depend on how the tables lie. Rows of
    ``labels`` and ``docs`` outside the training folds are left out before.
    """
    seen = labels.where("toxic IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    counts = seen.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    n_docs = docs.count()
    if not counts["p"] or not n_docs:
        return docs.limit(0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("side")), 0.0
    share = lambda most, n: F.xxhash64(F.lit(29), "id").bitwiseAND(0xFFFFFF) < F.lit(int(most / n * (1 << 24)) if most < n else 1 << 24)
    chosen = seen.where("toxic = 1").where(share(positives, counts["p"])).select("id")  # at most about ``positives`` ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    p = texts.join(F.broadcast(chosen), "id", "left_semi").select("id", "text", F.lit(1).alias("side"))
    u = texts.where(share(unlabelled, n_docs)).select("id", "text", F.lit(0).alias("side"))
    return p.union(u), counts["p"] / counts["n"]


def choose_features(sample: DataFrame, n_positive: int, n_unlabelled: int, most: int, least_z: float) -> np.ndarray:
    """Hashes of the features whose shares differ most; counts are added up per part of the hash range."""
    part = (2 << BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2 << BITS), np.int32)
        for batch in batches:
            sides = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, BATCH):
                row, key = hashed_features(batch.column(0).slice(at, BATCH))
                side = sides[at + row]
                for k in (0, 1):
                    seen[k] += np.bincount(key[side == k], minlength=2 << BITS).astype(np.int32)
        rows = []
        for k in range(PARTS):
            own = seen[:, k * part:(k + 1) * part]
            at = np.flatnonzero(own.any(0))
            if len(at):
                rows.append((k, at.astype("<i4").tobytes(), own[:, at].astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "at", "counts"])

    def differing(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros((2, part), np.int64)
        for at, counts in zip(rows["at"], rows["counts"]):
            seen[:, np.frombuffer(at, "<i4")] += np.frombuffer(counts, "<i4").reshape(2, -1)
        u, p = seen[0] / max(1, n_unlabelled), seen[1] / max(1, n_positive)
        both = (seen[0] + seen[1] + 1) / (n_positive + n_unlabelled + 2)
        z = (p - u) / np.sqrt(both * (1 - both) * (1 / max(1, n_positive) + 1 / max(1, n_unlabelled)))
        best = np.argsort(-np.abs(z), kind="stable")[:most]
        return pd.DataFrame({"hash": best + key[0] * part, "z": z[best]})

    counted = small_batches(sample).select("text", "side").mapInArrow(count, "part int, at binary, counts binary")
    best = counted.groupBy("part").applyInPandas(differing, "hash long, z double")
    rows = best.where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "hash").limit(most).collect()
    return np.array(sorted(r["hash"] for r in rows), np.int64)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 100, rate: float = 0.05, decay: float = 1e-4,
             seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer under the non-negative positive-unlabelled risk.

    Sigmoid loss, Adam steps over shuffled batches. ``positive`` and ``unlabelled`` are 0/1
    matrices; without positives every score is low.
    """
    k = positive.shape[1]
    w, b = np.zeros(k), 0.0
    if not len(positive) or not len(unlabelled):
        return w, -4.0
    rng = np.random.default_rng(seed)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    step = 0
    batches = max(1, min(8, len(positive) // 64))
    for _ in range(rounds):
        ps, us = np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)
        for pi, ui in zip(ps, us):
            p, u = positive[pi], unlabelled[ui]
            fp, fu = 1 / (1 + np.exp(-np.clip(p @ w + b, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w + b, -30, 30)))
            dp, du = fp * (1 - fp) / max(1, len(p)), fu * (1 - fu) / max(1, len(u))
            # loss of a positive: 1 - f; of a negative: f
            negative = fu.mean() - prior * fp.mean()
            up = np.concatenate([du @ u, [du.sum()]]) - prior * np.concatenate([dp @ p, [dp.sum()]])
            grad = -up if negative < 0 else up - prior * np.concatenate([dp @ p, [dp.sum()]])
            grad[:-1] += decay * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit a scorer on a bounded sample of ``docs``: those whose id ``labels`` confirms toxic, and any.

    ``labels`` needs the id and ``toxic``; other columns are not read. A table without a
    toxic label gives a scorer whose scores are all low.
    """
    sample, prior = sampled(docs, labels, positives, unlabelled, id_col, text_col)
    sides = {r["side"]: r["n"] for r in sample.groupBy("side").agg(F.count("*").alias("n")).collect()}
    hashes = choose_features(sample, sides.get(1, 0), sides.get(0, 0), features, LEAST_Z) if sides.get(1) else np.zeros(0, np.int64)
    model = Model(hashes, np.zeros(len(hashes)), -4.0)
    if not len(hashes):
        return model
    slot, wanted = model.slots()

    def has(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.zeros(0, np.int64)] * batch.num_rows
        for at in range(0, batch.num_rows, BATCH):
            row, feature = text_features(batch.column(0).slice(at, BATCH), slot, wanted)
            n = min(BATCH, batch.num_rows - at)
            own[at:at + n] = np.split(feature, np.searchsorted(row, np.arange(1, n)))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.astype("<u2").tobytes() for x in own], pa.binary())], names=["side", "features"])

    rows = map_texts(sample, ["text", "side"], "side int, features binary", lambda: has).toPandas()
    sets = {0: [], 1: []}
    for side, x in zip(rows["side"], rows["features"]):
        sets[side].append(np.frombuffer(x, "<u2"))

    def matrix(own: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(own), len(hashes)), np.float32)
        for i, x in enumerate(sorted(own, key=lambda x: x.tobytes())):
            out[i, x] = 1
        return out

    weights, bias = fit_nnpu(matrix(sets[1]), matrix(sets[0]), prior)
    return Model(hashes, weights, bias)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` and, as ``out``, the score of its whole text, from 0 to 1.

    Null and empty texts have the score of a text without features.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))  # bounded: at most FEATURES weights

    def make():
        own = Model(*sent.value)
        slot, wanted = own.slots()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            margin = np.full(batch.num_rows, own.bias)
            for at in range(0, batch.num_rows, BATCH):
                row, feature = text_features(batch.column(0).slice(at, BATCH), slot, wanted)
                n = min(BATCH, batch.num_rows - at)
                margin[at:at + n] += np.bincount(row, own.weights[feature], minlength=n)
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=[*batch.schema.names[1:], out])

        return step

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    return map_texts(docs.select(F.col(text_col).alias("__text"), *keep), ["__text", *keep], T.StructType([*fields, T.StructField(out, T.DoubleType())]), make)


def judged(docs: DataFrame, labels: DataFrame, holdout: int = 5) -> DataFrame:
    """Id, whether the row was held out of training, score and decision of every document.

    Rows whose id has crc32 modulo ``holdout`` of 0 take no part in training, neither their
    labels nor their texts. Repeated rows stay repeated, other columns are not read, an empty
    table gives an empty result.
    """
    train_docs, train_labels = docs.where(fold("doc_id", holdout) != 0), labels.where(fold("doc_id", holdout) != 0)
    scored = score(docs, train(train_docs, train_labels), ["doc_id"])
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", holdout) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
