"""Anomaly detectors: isolation forest and an ensemble of small autoencoders."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.incstats import packet_vectors
from tidewatch.operators.learn import correlation_matrix
from tidewatch.operators.scans import order_statistics
from tidewatch.runtime import materialize

# --- isolation forest ---------------------------------------------------------------------


def _mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    value = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, list, list, list]:
    """Random splits until rows are alone or the depth limit is reached.

    Nodes are (feature or -1, threshold, left child, path length at a leaf).
    """
    feature, cut, left, path = [], [], [], []
    todo = [(np.arange(len(x)), 0, -1)]
    while todo:
        rows, depth, parent = todo.pop(0)
        node = len(feature)
        if parent >= 0 and left[parent] < 0:
            left[parent] = node
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            feature.append(-1), cut.append(0.0), left.append(-1), path.append(float(depth + _mean_depth(len(rows))))
            continue
        f = int(rng.choice(open_features))
        at = float(rng.uniform(low[f], high[f]))
        feature.append(f), cut.append(at), left.append(-1), path.append(0.0)
        below = x[rows, f] <= at
        todo += [(rows[below], depth + 1, node), (rows[~below], depth + 1, node)]
    return feature, cut, left, path


@dataclass
class IsolationForest:
    """Trees as plain arrays: at most ``trees * 2 * sample`` nodes, whatever the input size."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int

    @classmethod
    def fit(cls, df: DataFrame, column: str, ids: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationForest:
        """Every tree sees about ``sample`` rows picked by hash and is grown in its own task."""
        total = df.count()
        share = min(1.0, 2.0 * sample / max(total, 1))
        scale = 1 << 30
        draws = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                         lambda t: F.pmod(F.xxhash64(*ids, t, F.lit(seed)), F.lit(scale)) < F.lit(int(share * scale)))
        drawn = df.select(vector_to_array(column).alias("x"), *ids, F.explode(draws).alias("tree")).select(
            "x", "tree", F.xxhash64(*ids, "tree", F.lit(seed + 1)).alias("o"))
        size = min(sample, total)
        limit = max(1, int(np.ceil(np.log2(max(size, 2)))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            rows = pdf.sort_values("o").head(size)
            nodes = _grow(np.array(rows["x"].tolist()), np.random.default_rng(seed * 1000 + tree), limit)
            return pd.DataFrame({"tree": [tree], "feature": [nodes[0]], "cut": [nodes[1]], "left_child": [nodes[2]], "path": [nodes[3]]})

        found = drawn.groupBy("tree").applyInPandas(
            grow, "tree int, feature array<int>, cut array<double>, left_child array<int>, path array<double>").orderBy("tree").collect()
        return cls([tuple(np.array(r[c]) for c in ("feature", "cut", "left_child", "path")) for r in found], size)

    def score(self, df: DataFrame, column: str) -> DataFrame:
        """Add ``anomaly_score`` (negative, lower is stranger) and ``label`` (-1 or 1)."""
        trees, normal = self.trees, float(_mean_depth(self.sample))

        @F.pandas_udf("double")
        def judged(x: pd.Series) -> pd.Series:
            m = np.array(x.tolist())
            depth = np.zeros(len(m))
            for feature, cut, left, path in trees:
                at = np.zeros(len(m), dtype=int)
                inner = feature[at] >= 0
                while inner.any():
                    rows = np.flatnonzero(inner)
                    node = at[rows]
                    at[rows] = left[node] + (m[rows, feature[node]] > cut[node])
                    inner = feature[at] >= 0
                depth += path[at]
            return pd.Series(-(2.0 ** (-(depth / len(trees)) / max(normal, 1e-9))))

        return df.withColumn("anomaly_score", judged(vector_to_array(column))).withColumn(
            "label", F.when(F.col("anomaly_score") < -0.5, -1).otherwise(1))


# --- ensemble of small autoencoders -----------------------------------------------------------

#: Packets that map and train an ensemble.
MAP_ROWS, TRAIN_ROWS = 5_000, 50_000


def feature_groups(corr: np.ndarray, largest: int = 10, above: float = 0.3) -> list[list[int]]:
    """Greedy groups: each free feature takes the free features it correlates with most.

    Works on the correlation matrix alone, whose size depends on the features only. Correlations count to nine
    digits, so that equal ones tie however their sums were rounded.
    """
    corr = np.round(corr, 9)
    free, groups = set(range(len(corr))), []
    for i in range(len(corr)):
        if i not in free:
            continue
        ranked = sorted((j for j in free if j != i and abs(corr[i, j]) > above), key=lambda j: (-abs(corr[i, j]), j))
        groups.append([i, *ranked[: largest - 1]])
        free -= set(groups[-1])
    return groups


class TinyEncoder:
    """One hidden layer of hyperbolic tangents and a linear output, trained in small batches."""

    #: Rows of one update: a batch is a handful of matrix products.
    BATCH = 32

    def __init__(self, inputs: int, ratio: float, rate: float, seed: int, mean=None, std=None):
        hidden = max(1, int(inputs * ratio))
        rng, limit = np.random.default_rng(seed), np.sqrt(6.0 / (inputs + hidden))
        self.w1, self.w2 = rng.uniform(-limit, limit, (inputs, hidden)), rng.uniform(-limit, limit, (hidden, inputs))
        self.b1, self.b2, self.rate = np.zeros(hidden), np.zeros(inputs), rate
        self.mean, self.std = mean, std

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return x if self.mean is None else (x - self.mean) / (self.std + 1e-10)

    def errors(self, rows: np.ndarray) -> np.ndarray:
        x = self._ready(rows)
        back = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return np.sqrt(((x - back) ** 2).mean(axis=1))

    def learn(self, rows: np.ndarray) -> np.ndarray:
        """Error of every row before the update of its batch."""
        out = np.empty(len(rows))
        ready = self._ready(rows)
        for at in range(0, len(ready), self.BATCH):
            x = ready[at:at + self.BATCH]
            hidden = np.tanh(x @ self.w1 + self.b1)
            error = x - hidden @ self.w2 - self.b2
            out[at:at + len(x)] = np.sqrt((error * error).mean(axis=1))
            # the step of a batch is the mean of its rows' steps, shortened where errors are large
            step = self.rate / len(x) * error / np.maximum(1.0, np.linalg.norm(error, axis=1, keepdims=True))
            inner = (step @ self.w2.T) * (1 - hidden * hidden)
            self.w2 += hidden.T @ step
            self.b2 += step.sum(axis=0)
            self.w1 += x.T @ inner
            self.b1 += inner.sum(axis=0)
        return out

    def state(self) -> list[float]:
        return np.concatenate([self.w1.ravel(), self.w2.ravel(), self.b1, self.b2]).tolist()

    def restore(self, flat: list[float]) -> TinyEncoder:
        parts, at = [], 0
        for shape in (self.w1.shape, self.w2.shape, self.b1.shape, self.b2.shape):
            size = int(np.prod(shape))
            parts.append(np.array(flat[at : at + size]).reshape(shape))
            at += size
        self.w1, self.w2, self.b1, self.b2 = parts
        return self


#: A saved ensemble: at most one row per feature and one more.
ENSEMBLE = "grp int, inputs array<int>, weights array<double>, mean array<double>, std array<double>, threshold double"


@dataclass
class EncoderEnsemble:
    """Small autoencoders over feature groups and one over their errors.

    Training is defined on the first packets only: ``map_rows`` to group the features and
    ``train_rows`` to learn. Both are parameters of the method, so its input is bounded.
    Inside the training range the groups do not influence each other, so each is trained
    in its own task; the output encoder then learns from their errors.
    """

    groups: list[list[int]]
    members: list[TinyEncoder]
    output: TinyEncoder
    threshold: float

    @classmethod
    def fit(cls, df: DataFrame, ordinal: str, column: str, map_rows: int = MAP_ROWS, train_rows: int = TRAIN_ROWS,
            largest: int = 10, rate: float = 0.1, ratio: float = 0.75, percentile: float = 99.0, seed: int = 42) -> EncoderEnsemble:
        """``ordinal`` numbers the packets from 0 without gaps; ``column`` is an array.

        Raises ``ValueError`` if either range holds no packet.
        """
        from pyspark.ml.functions import array_to_vector

        head = materialize(df.where(F.col(ordinal) < map_rows + train_rows).select(F.col(ordinal).alias("no"), F.col(column).alias("x")), "head")
        mapped = head.where(F.col("no") < map_rows)
        seen = head.agg(F.count_if(F.col("no") < map_rows), F.count_if(F.col("no") >= map_rows)).first()
        if not seen[0] or not seen[1]:
            raise ValueError(f"no packets to learn from: {seen[0]} of {map_rows} to map, {seen[1]} of {train_rows} to train")
        corr = correlation_matrix(mapped.select(array_to_vector("x").alias("v")), "v")
        groups = feature_groups(corr, largest)
        width = len(corr)
        moments = mapped.agg(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        mean = np.array([moments[f"m{i}"] for i in range(width)])
        std = np.array([moments[f"s{i}"] for i in range(width)])
        std[std < 1e-10] = 1.0

        def member(g: int) -> TinyEncoder:
            at = groups[g]
            return TinyEncoder(len(at), ratio, rate, seed + g, mean[at], std[at])

        slices = F.array(*[F.struct(F.lit(g).alias("grp"), F.array(*[F.get("x", F.lit(i)) for i in at]).alias("part")) for g, at in enumerate(groups)])
        rows = head.where(F.col("no") >= map_rows).select("no", F.explode(slices).alias("e")).select("no", "e.*")
        schema = "grp int, no bigint, rmse double, weights array<double>"

        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("no")
            g = int(pdf["grp"].iloc[0])
            coder = member(g)
            errors = coder.learn(np.array(pdf["part"].tolist()))
            out = pd.DataFrame({"grp": g, "no": pdf["no"].to_numpy(), "rmse": errors, "weights": None})
            last = pd.DataFrame({"grp": [g], "no": [-1], "rmse": [0.0], "weights": [coder.state()]})
            return pd.concat([out, last])

        trained = materialize(rows.groupBy("grp").applyInPandas(train, schema), "members")
        weights = {r["grp"]: r["weights"] for r in trained.where("no = -1").collect()}
        members = [member(g).restore(weights[g]) for g in range(len(groups))]
        table = trained.where("no >= 0").groupBy("no").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("grp", "rmse"))), lambda e: e["rmse"]).alias("errors"))

        def train_output(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("no")
            coder = TinyEncoder(len(groups), ratio, rate, seed - 1)
            errors = coder.learn(np.array(pdf["errors"].tolist()))
            return pd.DataFrame({"threshold": [float(np.percentile(errors, percentile))], "weights": [coder.state()]})

        # at most ``train_rows`` rows of one number per group
        last = table.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(train_output, "threshold double, weights array<double>").first()
        output = TinyEncoder(len(groups), ratio, rate, seed - 1)
        return cls(groups, members, output.restore(last["weights"]), last["threshold"])

    def save(self, spark, path: str) -> None:
        """One row per encoder and one, numbered -1, for the output encoder and the threshold."""
        rows = [(g, list(map(int, at)), c.state(), c.mean.tolist(), c.std.tolist(), 0.0) for g, (at, c) in enumerate(zip(self.groups, self.members))]
        rows.append((-1, [], self.output.state(), [], [], float(self.threshold)))
        spark.createDataFrame(rows, ENSEMBLE).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, rate: float = 0.1, ratio: float = 0.75) -> EncoderEnsemble:
        """The ensemble that ``save`` has written; ``ratio`` must be that of the training."""
        *members, last = [r for r in spark.read.parquet(path).orderBy(F.col("grp") < 0, "grp").collect()]
        coders = [TinyEncoder(len(r["inputs"]), ratio, rate, 0, np.array(r["mean"]), np.array(r["std"])).restore(r["weights"]) for r in members]
        return cls([r["inputs"] for r in members], coders, TinyEncoder(len(members), ratio, rate, 0).restore(last["weights"]), last["threshold"])

    def score(self, df: DataFrame, column: str, ordinal: str | None = None, trained_until: int = 0) -> DataFrame:
        """Error, label (-1 anomaly) and probability; rows of the training range get 0.5."""
        groups, members, output = self.groups, self.members, self.output

        @F.pandas_udf("double")
        def rmse(x: pd.Series) -> pd.Series:
            m = np.array(x.tolist())
            inner = np.column_stack([c.errors(m[:, at]) for c, at in zip(members, groups)])
            return pd.Series(output.errors(inner))

        out = df.withColumn("rmse", rmse(F.col(column)))
        live = F.lit(True) if ordinal is None else F.col(ordinal) >= trained_until
        limit = F.lit(self.threshold)
        return out.withColumns({
            "is_training": ~live, "rmse": F.when(live, F.col("rmse")).otherwise(0.0),
            "label": F.when(live & (F.col("rmse") > limit), -1).otherwise(1),
            "probability": F.when(live, F.least(F.lit(1.0), F.col("rmse") / (limit * 2))).otherwise(0.5)})


def in_training(rows: DataFrame) -> DataFrame:
    """What packets of the training range get, as ``EncoderEnsemble.score`` gives it."""
    return rows.withColumns({"is_training": F.lit(True), "rmse": F.lit(0.0), "label": F.lit(1), "probability": F.lit(0.5)})


def ensemble_scores(packets: DataFrame, map_rows: int = MAP_ROWS, train_rows: int = TRAIN_ROWS, **settings) -> DataFrame:
    """Error, label and probability of every packet by an ensemble of its first ``map_rows + train_rows`` packets.

    A vector depends on its packet and the ones before it, so those of the training range are made of that range alone; all
    vectors are scored as they come and never written. A table that holds no packet to train on is in training as a whole.
    """
    trained_until = map_rows + train_rows
    if packets.where(F.col("pkt_no") >= map_rows).isEmpty():
        return in_training(packets.select("pkt_no"))
    model = EncoderEnsemble.fit(packet_vectors(packets.where(F.col("pkt_no") < trained_until)), "pkt_no", "vector", map_rows, train_rows, **settings)
    return model.score(packet_vectors(packets), "vector", "pkt_no", trained_until)


def threshold_labels(df: DataFrame, error: str, threshold: float) -> DataFrame:
    """Label and probability of given errors against a threshold."""
    limit = F.lit(threshold)
    return df.withColumns({
        "label": F.when(F.col(error) > limit, -1).otherwise(1),
        "probability": F.least(F.lit(1.0), F.col(error) / (limit * 2))})


def percentile_value(df: DataFrame, column: str, percentile: float) -> DataFrame:
    """Exact percentile with linear interpolation between the two middle ranks."""
    at = (F.col("n") - 1) * F.lit(percentile / 100.0)
    found = order_statistics(df, column, {"a": F.floor(at), "b": F.ceil(at)})
    n = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    share = (n - 1) * F.lit(percentile / 100.0)
    return found.select((F.col("a") + (F.col("b") - F.col("a")) * (share - F.floor(share))).alias("threshold"))


