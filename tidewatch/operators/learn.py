"""Model training and scoring on feature tables."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel,
    MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    HashingTF, IDF, PCA, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors, VectorUDT
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import boosting, evals, gradients, kernels, sampling  # noqa: F401  (boosting and kernels register families)
from tidewatch.operators.scans import order_statistics
from tidewatch.operators.scorers import make_model, model
from tidewatch.runtime import BLOCK_ROWS, dealt, materialize, spread

FEATURES, LABEL = "features", "label"


def split_tables(df: DataFrame, ids: list[str], test_size: float = 0.2, seed: int = 42, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split and write both parts once, in files of up to about ``BLOCK_ROWS`` rows; training reads its input many times."""
    marked = dealt(sampling.mark_fraction(df, ids, fraction=test_size, seed=seed, by=by, out="_test"), "split", *ids, least=-(-df.count() // BLOCK_ROWS))
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Alphabetical codes of text columns; values unseen at fit time get the next code."""
    indexer = StringIndexer(inputCols=columns, outputCols=[f"{c}_code" for c in columns],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
    return indexer.fit(df).transform(df)


class DenseNetwork(MultilayerPerceptronClassifier):
    """Spark's perceptron, its start and its model; the steps are those of ``gradients.minimised`` over packed blocks of rows."""

    def fit(self, dataset: DataFrame, params: dict | None = None) -> Model:
        if params:
            return self.copy(params).fit(dataset)
        net = gradients.Layers(self.getLayers())
        rows = gradients.packed(dataset, self.getFeaturesCol(), F.col(self.getLabelCol()).cast("double"))
        # without a step, a fit of one row gives a model of the weights at hand
        one = dataset.sparkSession.createDataFrame(
            [(Vectors.dense([0.0] * self.getLayers()[0]), 0.0)], T.StructType([T.StructField(self.getFeaturesCol(), VectorUDT()), T.StructField(self.getLabelCol(), T.DoubleType())]))
        still = MultilayerPerceptronClassifier(**{p.name: v for p, v in self.extractParamMap().items()} | {"maxIter": 0})

        def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
            n, total, grad = gradients.gradient(rows, net, flat)
            return total / n, grad / n

        flat = gradients.minimised(objective, still.fit(one).weights.toArray(), self.getMaxIter(), self.getTol())
        return still.copy({still.initialWeights: Vectors.dense(flat)}).fit(one)


# --- the model families -----------------------------------------------------------------


@model("random_forest")
def random_forest(trees: int = 100, depth: int = 20, seed: int = 42) -> Estimator:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol=LABEL)


@model("decision_tree")
def decision_tree(depth: int = 10, seed: int = 42) -> Estimator:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed, labelCol=LABEL)


@model("gradient_boosting")
def gradient_boosting(rounds: int = 100, rate: float = 0.1, depth: int = 3, seed: int = 42) -> Estimator:
    return GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, labelCol=LABEL)


@model("logistic_regression")
def logistic_regression(regularization: float = 0.0, iterations: int = 100) -> Estimator:
    return LogisticRegression(regParam=regularization, maxIter=iterations, labelCol=LABEL)


@model("naive_bayes")
def naive_bayes(smoothing: float = 1e-9) -> Estimator:
    return NaiveBayes(modelType="gaussian", smoothing=smoothing, labelCol=LABEL)


@model("linear_svc")
def linear_svc(regularization: float = 0.1, iterations: int = 100) -> Estimator:
    return LinearSVC(regParam=regularization, maxIter=iterations, labelCol=LABEL)


@model("dense_network")
def dense_network(inputs: int, hidden: tuple = (64, 32), classes: int = 2, iterations: int = 100, seed: int = 42) -> Estimator:
    return DenseNetwork(layers=[inputs, *hidden, classes], maxIter=iterations, seed=seed, labelCol=LABEL)


# --- preparation --------------------------------------------------------------------------


def assembled(df: DataFrame, columns: list[str], label: Column | None = None) -> DataFrame:
    """Feature vector (missing values as 0) and, when given, a 0/1 label as double."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    out = spread(df).withColumn(FEATURES, array_to_vector(values))
    return out if label is None else out.withColumn(LABEL, label.cast("double"))


def prepare(df: DataFrame, columns: list[str], label: str, ids: list[str], test_size: float = 0.2,
            scale: bool = False, balance: str = "none", seed: int = 42) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Pick columns, split, balance the training part and optionally scale on it."""
    train, test = split_tables(df.select(*ids, *columns, label), ids, test_size, seed)
    train = sampling.balance(train, label, ids, balance, seed, features=columns)
    steps: list = [VectorAssembler(inputCols=columns, outputCol="raw" if scale else FEATURES, handleInvalid="keep")]
    if scale:
        steps.append(StandardScaler(withMean=True, inputCol="raw", outputCol=FEATURES))
    fitted = Pipeline(stages=steps).fit(train)
    return fitted.transform(train), fitted.transform(test), fitted


# --- scoring --------------------------------------------------------------------------------


def score(fitted: Model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (probability of class 1 where the model gives one) and ``y_pred``."""
    out = fitted.transform(df)
    if "probability" in out.columns:
        p = F.get(vector_to_array("probability"), F.lit(1))
    else:
        p = F.col("prediction").cast("double")
    drop = [c for c in ("rawPrediction", "probability", "prediction") if c in out.columns]
    return out.withColumn("score", p).withColumn("y_pred", (F.col("score") > threshold).cast("int")).drop(*drop)


def evaluate(scored: DataFrame) -> DataFrame:
    return evals.classification_metrics(scored.withColumn("y_true", F.col(LABEL).cast("int")))


def test_report(fitted: Model, test: DataFrame, ids: list[str]) -> DataFrame:
    """Scored test rows with readable labels."""
    from tidewatch.operators.labels import verdict_text

    out = score(fitted, test).withColumn("y_true", F.col(LABEL).cast("int"))
    return out.select(*ids, "y_true", "y_pred", "score", verdict_text(F.col("y_pred")).alias("verdict"))


# --- search ----------------------------------------------------------------------------------

# --- fixed values: settings tried per family --------------------------------------------------
GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {"numTrees": [50, 100], "maxDepth": [10, 20]},
    "gradient_boosting": {"maxIter": [50, 100], "stepSize": [0.05, 0.1]},
    "ada_boost": {"maxIter": [50, 100], "stepSize": [0.1, 1.0]},
    "decision_tree": {"maxDepth": [5, 10, 20]},
    "logistic_regression": {"C": [0.1, 1.0]},
    "naive_bayes": {"smoothing": [1e-9]},
    "linear_svc": {"C": [1.0, 10.0]},
}


def penalty(c: float, rows: float) -> float:
    """Spark's ``regParam`` for an inverse strength ``c``: Spark averages the loss over the rows
    while the inverse strength weighs their sum."""
    return 1.0 / (c * max(1.0, rows))


def _grid(estimator: Estimator, settings: dict[str, list], rows: float) -> list:
    builder = ParamGridBuilder()
    for name, values in settings.items():
        if name == "C":
            name, values = "regParam", [penalty(c, rows) for c in values]
        builder = builder.addGrid(estimator.getParam(name), values)
    return builder.build()


def grid_search(train: DataFrame, grids: dict[str, dict[str, list]] | None = None, folds: int = 3,
                metric: str = "accuracy", parallelism: int = 4, seed: int = 42) -> tuple[dict[str, float], dict[str, Model]]:
    """Best cross-validated score and refitted model per family."""
    scores, models = {}, {}
    judge = MulticlassClassificationEvaluator(labelCol=LABEL, metricName=metric)
    rows = train.count() * (folds - 1) / folds
    for name, settings in (grids or GRIDS).items():
        estimator = make_model(name)
        cv = CrossValidator(estimator=estimator, estimatorParamMaps=_grid(estimator, settings, rows), evaluator=judge,
                            numFolds=folds, parallelism=parallelism, seed=seed)
        fitted = cv.fit(train)
        scores[name], models[name] = max(fitted.avgMetrics), fitted.bestModel
    return scores, models


def random_search(train: DataFrame, name: str, ranges: dict[str, Callable[[random.Random], object]], trials: int = 10,
                  folds: int = 3, metric: str = "f1", parallelism: int = 4, seed: int = 42) -> tuple[dict, float, Model]:
    """Seeded random settings, all judged by one cross-validation."""
    rng = random.Random(seed)
    estimator = make_model(name)
    maps = [{estimator.getParam(p): draw(rng) for p, draw in ranges.items()} for _ in range(trials)]
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, numFolds=folds, parallelism=parallelism, seed=seed,
                        evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName=metric))
    fitted = cv.fit(train)
    best = max(range(trials), key=lambda i: fitted.avgMetrics[i])
    return {p.name: v for p, v in maps[best].items()}, fitted.avgMetrics[best], fitted.bestModel


def cross_validated(df: DataFrame, estimator: Estimator, ids: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold scores of every row."""
    numbered = dealt(sampling.folds(df, ids, folds, seed), "folds", *ids)
    parts = []
    for f in range(folds):
        fitted = estimator.fit(numbered.where(F.col("fold") != f))
        parts.append(score(fitted, numbered.where(F.col("fold") == f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_f1(df: DataFrame, estimators: dict[str, Estimator], ids: list[str], folds: int = 5, seed: int = 42) -> dict[str, float]:
    """F1 of each estimator over its out-of-fold scores: what vote weights are made of."""
    return {n: evaluate(cross_validated(df, e, ids, folds, seed)).first()["f1"] for n, e in estimators.items()}


def cv_metrics(df: DataFrame, estimator: Estimator, ids: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Mean and deviation over the folds of accuracy, precision, recall and F1."""
    scored = cross_validated(df, estimator, ids, folds, seed).withColumn("y_true", F.col(LABEL).cast("int"))
    per_fold = evals.classification_metrics(scored, ["fold"])
    names = ["accuracy", "precision", "recall", "f1"]
    return per_fold.agg(*[F.avg(n).alias(f"{n}_mean") for n in names], *[F.stddev_pop(n).alias(f"{n}_std") for n in names])


# --- ensembles ----------------------------------------------------------------------------------


def vote_weights(f1_by_model: dict[str, float]) -> dict[str, float]:
    total = sum(f1_by_model.values())
    return {k: v / total for k, v in f1_by_model.items()}


def soft_vote(scores: list[str], weights: list[float] | None = None) -> Column:
    w = weights or [1.0] * len(scores)
    parts = [F.col(s) * x for s, x in zip(scores, w)]
    return sum(parts[1:], parts[0]) / sum(w)


def hard_vote(scores: list[str], weights: list[float] | None = None, threshold: float = 0.5) -> Column:
    """Class with the larger weight of votes; 0 on ties."""
    w = weights or [1.0] * len(scores)
    ones = [F.when(F.col(s) > threshold, x).otherwise(0.0) for s, x in zip(scores, w)]
    return (sum(ones[1:], ones[0]) * 2 > sum(w)).cast("int")


def base_scores(models: dict[str, Model], df: DataFrame) -> DataFrame:
    """One score column per model; the rows are read once."""
    for name, fitted in models.items():
        df = score(fitted, df).withColumnRenamed("score", f"score_{name}").drop("y_pred")
    return df


def _meta_input(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(FEATURES).withColumn(FEATURES, array_to_vector(F.array(*[F.col(f"score_{n}") for n in names])))


class Ensemble:
    """Base models with a meta model over their scores."""

    def __init__(self, bases: dict[str, Model], meta: Model) -> None:
        self.bases, self.meta = bases, meta

    def score(self, df: DataFrame) -> DataFrame:
        scored = base_scores(self.bases, df)
        return score(self.meta, _meta_input(scored, list(self.bases)))


def stack(train: DataFrame, estimators: dict[str, Estimator], ids: list[str], folds: int = 5, seed: int = 42,
          meta: Estimator | None = None) -> Ensemble:
    """Meta model over out-of-fold base scores, base models refitted on all rows."""
    numbered = dealt(sampling.folds(train, ids, folds, seed), "folds", *ids)
    parts = []
    for f in range(folds):
        fitted = {n: e.fit(numbered.where(F.col("fold") != f)) for n, e in estimators.items()}
        parts.append(base_scores(fitted, numbered.where(F.col("fold") == f)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    top = (meta or logistic_regression()).fit(_meta_input(rows, list(estimators)))
    return Ensemble({n: e.fit(numbered) for n, e in estimators.items()}, top)


def blend(train: DataFrame, estimators: dict[str, Estimator], ids: list[str], holdout: float = 0.2, seed: int = 42,
          meta: Estimator | None = None) -> Ensemble:
    """Meta model over the scores of a stratified hold-out, base models refitted on all rows."""
    marked = dealt(sampling.mark_fraction(train, ids, fraction=holdout, seed=seed, by=LABEL, out="_held", few_classes=True), "holdout", *ids)
    rest, held = marked.where(~F.col("_held")).drop("_held"), marked.where("_held").drop("_held")
    train = marked.drop("_held")
    fitted = {n: e.fit(rest) for n, e in estimators.items()}
    top = (meta or logistic_regression()).fit(_meta_input(base_scores(fitted, held), list(estimators)))
    return Ensemble({n: e.fit(train) for n, e in estimators.items()}, top)


# --- explanation -----------------------------------------------------------------------------------


def feature_importance(fitted: Model, names: list[str], spark) -> DataFrame:
    """Importance per feature: impurity based for trees, absolute coefficients otherwise."""
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    else:
        values = abs(fitted.coefficients.toArray())
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def linear_contributions(fitted: Model, df: DataFrame, names: list[str], limit: int = 10) -> DataFrame:
    """Contribution of every feature of a linear model, ``coefficient * (x - mean)``, with
    the ``limit`` largest; exact for independent features."""
    means = df.agg(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"].toArray()
    weights = fitted.coefficients.toArray()
    base = float(fitted.intercept + (weights * means).sum())
    x = vector_to_array(FEATURES)
    parts = F.array(*[(F.get(x, F.lit(i)) - F.lit(float(m))) * F.lit(float(w)) for i, (w, m) in enumerate(zip(weights, means))])
    rows = df.withColumn("contributions", parts).withColumn("base_value", F.lit(base))
    return evals.top_contributions(rows, names, "contributions", limit)


def permutation_importance(fitted: Model, df: DataFrame, names: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """Loss of accuracy when one feature is taken from another row.

    Rows are paired by rank inside hash buckets, so the exchange needs no global order.
    """
    from pyspark.sql import Window

    x = vector_to_array(FEATURES)
    bucket = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(-(-df.count() // BLOCK_ROWS) * 8))
    order = Window.partitionBy("_b").orderBy(F.xxhash64(*ids, F.lit(seed + 1)), *ids)
    ranked = df.withColumn("_b", bucket).withColumn("_x", x).withColumn("_other", F.lead("_x").over(order))
    first = F.first("_x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shuffled = materialize(ranked.withColumn("_other", F.coalesce("_other", first)).drop(FEATURES, "_b"), "permuted")
    if isinstance(fitted, LogisticRegressionModel) and fitted.numClasses == 2:
        hits = _linear_hits(fitted, shuffled, len(names))
    else:
        variants = F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1)))
        swapped = F.transform("_x", lambda v, i: F.when(i == F.col("variant"), F.get("_other", i)).otherwise(v))
        long = shuffled.withColumn("variant", variants).withColumn(FEATURES, array_to_vector(swapped))
        hits = score(fitted, long).groupBy("variant").agg(F.avg((F.col("y_pred") == F.col(LABEL)).cast("double")).alias("accuracy"))
    base = hits.where("variant = -1").select("accuracy").scalar()
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("variant"))
    return hits.where("variant >= 0").select(name.alias("feature"), (base - F.col("accuracy")).alias("importance"))


def _linear_hits(fitted: LogisticRegressionModel, shuffled: DataFrame, width: int) -> DataFrame:
    """Accuracy by variant: a value from another row moves the margin by its weight times the difference, so no row is copied."""
    weights, intercept = fitted.coefficients.toArray(), fitted.intercept

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, right = 0, np.zeros(width + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, other = gradients.matrix(batch.column(0)), gradients.matrix(batch.column(1))
                margin = x @ weights + intercept
                moved = np.c_[margin, margin[:, None] + (other - x) * weights]
                n, right = n + len(x), right + ((moved > 0) == (batch.column(2).to_numpy(zero_copy_only=False) == 1)[:, None]).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(right, pa.int64()), pa.array([n] * (width + 1), pa.int64())], names=["variant", "hits", "n"])

    known = shuffled.where(F.col(LABEL).isNotNull()).select("_x", "_other", LABEL)
    found = known.mapInArrow(count, "variant int, hits long, n long")
    return found.groupBy("variant").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))


# --- text and reconstruction -------------------------------------------------------------------------


def text_pipeline(buckets: int = 1 << 16, iterations: int = 50) -> Pipeline:
    """Bag of words with inverse document frequency and a logistic model."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+", minTokenLength=1),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=buckets),
        IDF(inputCol="counts", outputCol=FEATURES),
        LogisticRegression(labelCol=LABEL, maxIter=iterations)])


def score_texts(fitted: PipelineModel, texts: DataFrame, min_length: int = 10) -> DataFrame:
    """Probability per text; texts shorter than ``min_length`` get none."""
    long_enough = F.length(F.coalesce("text", F.lit(""))) >= min_length
    scored = score(fitted, texts.where(long_enough)).drop("words", "counts", FEATURES)
    return scored.unionByName(texts.where(~long_enough), allowMissingColumns=True)


def reconstruction(train: DataFrame, df: DataFrame, components: int = 10, percentile: float = 0.95) -> DataFrame:
    """Reconstruction error from the leading components and the anomaly label against the
    given percentile of the training error."""
    fitted = PCA(k=components, inputCol=FEATURES, outputCol="_pc").fit(train)
    axes: DenseMatrix = fitted.pc
    basis = axes.toArray()
    mean = train.agg(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"].toArray()

    def errors(rows: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def error(x: pd.Series) -> pd.Series:
            m = np.array(x.tolist()) - mean
            return pd.Series(((m - (m @ basis) @ basis.T) ** 2).mean(axis=1))

        return rows.withColumn("error", error(vector_to_array(FEATURES)))

    # the errors alone, as their order is found in several passes
    cut = order_statistics(materialize(errors(train).select("error"), "errors"), "error", {"t": F.floor((F.col("n") - 1) * percentile)}).select("t").scalar()
    return errors(df).withColumn("threshold", cut).withColumn("label", F.when(F.col("error") > F.col("threshold"), -1).otherwise(1))


def correlation_matrix(df: DataFrame, column: str = FEATURES):
    """Pearson correlations of a vector column; undefined entries are 0, also of a column with itself."""
    raw = Correlation.corr(df, column).first()[0].toArray()
    off = np.isnan(raw) | np.eye(len(raw), dtype=bool)
    flat = off.all(axis=1) & (len(raw) > 1)  # a column that does not vary has no correlation at all
    raw[flat, flat] = np.nan
    return np.nan_to_num(raw, nan=0.0)


def correlation_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same in long form for named columns: one row per pair, 0 where a column does not vary.

    Missing values count as 0. The matrix is of the number of columns squared.
    """
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    corr = correlation_matrix(df.select(array_to_vector(numbers).alias("v")), "v")
    rows = [(a, b, float(corr[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def area_under_curve(scored: DataFrame) -> float:
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=LABEL)
    return judge.evaluate(scored)


