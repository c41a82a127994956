"""Language of a text, predicted from the top down.

The learned languages are grouped into families of similar letter sequences. One linear support
vector machine per family picks the family; inside it, one machine per pair of languages
separates close relatives, and the language that wins most pairs is the prediction. The features
are shares of hashed byte 2- and 3-grams of the whole text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import fold, map_texts
from tidewatch.llm.grams import hashed, letter_bytes

#: Documented bounds of what the machines are fitted on: texts of a language, and of all.
PER_LANGUAGE, SAMPLE = 600, 4_000
BITS, GRAMS = 11, (2, 3)
BATCH = 256
UNKNOWN = "und"
#: With ``reject``, a text of ``SHORT`` characters or more is in no language when its score is at most this share of the
#: way from chance to 1 and its likeness to the nearest learned language is below ``LIKENESS``.
ABOVE_CHANCE, LIKENESS, SHORT = 0.3, 0.25, 16
LETTER = regex.compile(r"\p{L}").search


def text_shares(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of each hashed gram, a row of unit length per text."""
    letters, row = letter_bytes(texts)
    out = np.zeros((len(texts), len(GRAMS) << BITS), np.float32)
    for k, n in enumerate(GRAMS):
        grams, own = hashed(letters, row, n, BITS)
        counts = np.bincount((own.astype(np.int64) << BITS) + grams, minlength=len(texts) << BITS).reshape(len(texts), -1)
        out[:, k << BITS:k + 1 << BITS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return out / np.sqrt(len(GRAMS))


def fit_svm(rows: np.ndarray, side: np.ndarray, penalty: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; ``side`` is +1 or -1.

    Both sides weigh the same. Accelerated gradient steps of a fixed length over all rows.
    """
    side = side.astype(np.float32)  # all in the rows' own precision: no copy of them is made
    weight = np.where(side > 0, 0.5 / max(1, (side > 0).sum()), 0.5 / max(1, (side < 0).sum())).astype(np.float32)
    w, at = np.zeros(rows.shape[1] + 1, np.float32), np.zeros(rows.shape[1] + 1, np.float32)
    length = np.float32(1.0 / (4.0 + penalty))  # rows have length at most sqrt(2), the loss curvature 2
    for k in range(rounds):
        slack = np.maximum(np.float32(0), 1 - side * (rows @ at[:-1] + at[-1]))
        pull = 2 * weight * side * slack
        new = at - length * (np.float32(penalty) * at - np.append(pull @ rows, pull.sum()))
        w, at = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


def group_languages(centres: np.ndarray) -> list[list[int]]:
    """Families: the closest groups of languages are joined until about the root of their number is left."""
    groups = [[i] for i in range(len(centres))]
    near = centres @ centres.T
    while len(groups) > int(np.ceil(np.sqrt(len(centres)))):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: (near[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] += groups.pop(b)
    return groups


@dataclass
class Model:
    """Languages, families (indices of languages) and the weights of all machines."""

    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_weights: np.ndarray | None = None
    centres: np.ndarray | None = None

    def strange(self, rows: np.ndarray, family: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Whether the machines score a text near chance and it is like no learned language.

        A text in two learned languages scores low too, but stays like both. With one language
        there is no machine, and the likeness decides alone.
        """
        chance = np.array([1 / (len(self.families) * min(2, len(f))) for f in self.families])[family]
        return (score <= chance + ABOVE_CHANCE * (1 - chance)) & ((rows[:, :-1] @ self.centres.T).max(1) < LIKENESS)

    def predict(self, texts: pa.Array, reject: bool = False) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text: the family's share times the language's in it.

        ``reject`` turns texts in none of the learned languages into ``und``; their score stays.
        """
        n = len(texts)
        values = texts.to_pylist()
        plain = np.array([x is not None and LETTER(x) is not None for x in values], bool)
        if not self.languages or not n:
            return [UNKNOWN] * n, np.zeros(n)
        rows = np.hstack([text_shares(texts), np.ones((n, 1), np.float32)])
        if len(self.families) > 1:
            margin = rows @ self.family_weights.T
            share = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
            share /= share.sum(1, keepdims=True)
        else:
            share = np.ones((n, 1))
        family = share.argmax(1)
        score = share.max(1)
        chosen = np.array([f[0] for f in self.families])[family]
        if self.pairs:
            beats = 1 / (1 + np.exp(-np.clip(3 * (rows @ self.pair_weights.T), -30, 30)))
            votes, wins = np.zeros((n, len(self.languages))), np.zeros((n, len(self.languages)))
            for k, (a, b) in enumerate(self.pairs):
                votes[:, a] += beats[:, k] > 0.5
                votes[:, b] += beats[:, k] <= 0.5
                wins[:, a] += beats[:, k]
                wins[:, b] += 1 - beats[:, k]
            for f, own in enumerate(self.families):
                if len(own) > 1:
                    at = np.flatnonzero(family == f)
                    rank = votes[np.ix_(at, own)] + 1e-3 * wins[np.ix_(at, own)]
                    best = rank.argmax(1)
                    chosen[at] = np.array(own)[best]
                    score[at] *= wins[at, chosen[at]] / (len(own) - 1)
        score = np.where(plain, score, 0.0)
        if reject:
            plain &= ~(np.array([x is not None and len(x) >= SHORT for x in values], bool) & self.strange(rows, family, score))
        return [self.languages[c] if p else UNKNOWN for c, p in zip(chosen, plain)], score


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, lang_col: str = "lang", id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Fit the machines on about ``per_language`` texts of each language, chosen by the hash of the id.

    Rows without language or text are left out; so are texts without a letter. No usable row
    gives a model that knows no language.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).agg(F.count("*")).collect()}
    if not counts:
        return Model()
    most = max(1, min(per_language, sample // len(counts)))
    share: Column = F.coalesce(*[F.when(F.col(lang_col) == name, F.lit(int(min(1.0, most / n) * (1 << 24)))) for name, n in sorted(counts.items())])
    chosen = usable.where(F.xxhash64(F.lit(41), F.col(id_col)).bitwiseAND(0xFFFFFF) < share)

    def shares(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [text_shares(batch.column(0).slice(at, BATCH)).astype("<f2") for at in range(0, batch.num_rows, BATCH)]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for x in rows for r in x], pa.binary())], names=["lang", "shares"])

    found = map_texts(chosen.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), ["text", "lang"], "lang string, shares binary", lambda: shares).toPandas()
    order = sorted(range(len(found)), key=lambda i: (found["lang"].iat[i], hashlib.blake2b(found["shares"].iat[i], digest_size=16).digest()))
    x = np.empty((len(order), len(GRAMS) << BITS), np.float32)
    for row, i in enumerate(order):
        x[row] = np.frombuffer(found["shares"].iat[i], "<f2")
    names = found["lang"].to_numpy()[order]
    del found
    if not (on := x.any(1)).all():
        x, names = x[on], names[on]
    languages = sorted(set(names))
    if not languages:
        return Model()
    at = np.searchsorted(languages, names)
    centres = np.array([x[at == k].mean(0) for k in range(len(languages))])
    means = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres - centres.mean(0) if len(languages) > 2 else centres
    centres /= np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
    families = group_languages(centres)
    family_of = np.empty(len(languages), int)
    for f, own in enumerate(families):
        family_of[own] = f
    model = Model([str(v) for v in languages], families, centres=means.astype(np.float32))
    if len(families) > 1:
        model.family_weights = np.array([fit_svm(x, np.where(family_of[at] == f, 1, -1)) for f in range(len(families))], np.float32)
    model.pairs = [p for own in families for p in combinations(sorted(own), 2)]
    if model.pairs:
        model.pair_weights = np.array([fit_svm(x[(at == a) | (at == b)], np.where(at[(at == a) | (at == b)] == a, 1, -1)) for a, b in model.pairs], np.float32)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score"),
             reject: bool = False) -> DataFrame:
    """Columns ``keep`` of every row and, as ``out``, the predicted language of the whole text and a score from 0 to 1.

    A null text and one without a letter is ``und`` with score 0, and so is every text if no
    language was learned. ``reject`` adds texts that are like no learned language to ``und``.
    Repeated rows stay repeated; other columns are not read.
    """
    parts = (model.languages, model.families, model.family_weights, model.pairs, model.pair_weights, model.centres)
    sent = docs.sparkSession.sparkContext.broadcast(parts)  # bounded: a few weights per language and pair of relatives

    def make():
        own = Model(*sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = [], []
            for at in range(0, batch.num_rows, BATCH):
                n, s = own.predict(batch.column(0).slice(at, BATCH), reject)
                names += n
                scores.append(s)
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(np.concatenate(scores).astype(np.float64))],
                                              names=[*batch.schema.names[1:], *out])

        return step

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return map_texts(docs.select(F.col(text_col).alias("__text"), *keep), ["__text", *keep], schema, make)


def predicted(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Id, whether the row was held out of training, predicted language and score of every document.

    Rows whose id has crc32 modulo ``parts`` of ``held`` take no part in training.
    """
    model = train(docs.where(fold("doc_id", parts) != held))
    found = identify(docs, model, ["doc_id"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", parts) == held).alias("held_out"), "lang_pred", "score")
