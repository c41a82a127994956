"""Training, scoring, ensembles, explanation and anomaly detection."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import evals as E
from tidewatch.operators import flows as O
from tidewatch.operators import gradients as G
from tidewatch.operators import kernels as K
from tidewatch.operators import labels as L
from tidewatch.operators import learn as M
from tidewatch.operators import sampling
from tidewatch.operators.search import Range, model_search
from tidewatch.operators.trees import tree_contributions
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import query
from tidewatch.plans.vectors import CONNS, connection_rows
from tidewatch.runtime import materialize
from tidewatch.schemas import KDD_CATEGORICAL, KDD_NUMERIC
from tidewatch.schemas import PHISHING_FEATURES as FEATURES

IDS = ["row_id"]


def training_rows(t):
    return M.assembled(t.phishing, FEATURES, L.zero_one("Result")).select("row_id", "features", "label")


def trained(t, name="logistic_regression", **params):
    train, test = M.split_tables(training_rows(t), IDS)
    return M.make_model(name, **params).fit(train), train, test


CONN_COLUMNS = [*KDD_NUMERIC, *[f"{c}_code" for c in KDD_CATEGORICAL]]


def connection_training(t):
    # the label codes and the cut of a split read a few columns each; whole rows are made and written once, by the split
    rows = M.label_codes(connection_rows(t), KDD_CATEGORICAL)
    return M.assembled(rows, CONN_COLUMNS, L.is_attack()).select("flow_no", "flow_line", "attack_type", "features", "label")


@query("feature_correlations", "A25", f"WITH {CONNS}, w AS (SELECT " + ", ".join(
    f"CASE WHEN isnan(corr(\"{a}\", \"{b}\")) THEN 0 ELSE coalesce(corr(\"{a}\", \"{b}\"), 0) END AS \"{a}|{b}\"" for a in KDD_NUMERIC for b in KDD_NUMERIC)
    + " FROM conns), u AS (UNPIVOT w ON COLUMNS(*) INTO NAME pair VALUE r) SELECT split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, round(r, 6) + 0 AS r FROM u")
def feature_correlations(t):
    return M.correlation_rows(connection_rows(t), KDD_NUMERIC).select("a", "b", (F.round("r", 6) + F.lit(0.0)).alias("r"))


@query("batch_scored_connections", "S13 M16 M18")
def batch_scored_connections(t):
    train, test = M.split_tables(connection_training(t), ["flow_no", "flow_line"])
    fitted = M.make_model("random_forest").fit(train)
    return M.score(fitted, test).select("flow_no", "flow_line", "label", "score", "y_pred")


@query("scored_test_table", "M18 M19 F9")
def scored_test_table(t):
    fitted, _, test = trained(t)
    return M.test_report(fitted, test, IDS)


@query("test_set_metrics", "M16 M19 A15")
def test_set_metrics(t):
    out = None
    train, test = M.split_tables(training_rows(t), IDS)
    for name in ("decision_tree", "logistic_regression", "naive_bayes", "linear_svc", "gradient_boosting", "random_forest"):
        fitted = M.make_model(name).fit(train)
        part = M.evaluate(M.score(fitted, test)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("dense_network_scores", "M17")
def dense_network_scores(t):
    fitted, _, test = trained(t, "dense_network", inputs=30, hidden=(128, 64, 32))
    return M.score(fitted, test).select("row_id", "label", "score", "y_pred")


@query("prepared_tables", "M14 M12", with_views("phishing", "SELECT 'test' AS part, CAST(round(count(*)*0.2e0) AS BIGINT) AS cnt FROM phishing UNION ALL SELECT 'train', count(*) - CAST(round(count(*)*0.2e0) AS BIGINT) FROM phishing"))
def prepared_tables(t):
    rows = t.phishing.fillna(0)
    train, test, _ = M.prepare(rows, FEATURES, "Result", IDS, scale=True)
    both = train.select(F.lit("train").alias("part"), "features").unionByName(test.select(F.lit("test").alias("part"), "features"))
    return both.groupBy("part").agg(F.count("features").alias("cnt"))


@query("grid_search_scores", "M15 T7 E1")
def grid_search_scores(t):
    # every family of the grids but the three whose 36 ensembles of 50 or 100 trees take too long on a small machine (README)
    grids = {n: g for n, g in M.GRIDS.items() if n not in ("random_forest", "gradient_boosting", "ada_boost")}
    scores, _ = M.grid_search(materialize(training_rows(t), "rows"), grids)
    # the search result is one number per family; the table adds how many rows it saw
    cells = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(float(s)).alias("score")) for n, s in scores.items()])
    return t.phishing.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(cells).alias("e")).select("e.*", "rows")


@query("random_search_score", "M25")
def random_search_score(t):
    best, found, _ = M.random_search(materialize(training_rows(t), "rows"), "logistic_regression",
                                     {"regParam": lambda r: 10 ** r.uniform(-3, 0)})
    return t.phishing.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(float(best["regParam"])).alias("setting"), F.lit(float(found)).alias("f1"), "rows")


@query("model_search_score", "M25")
def model_search_score(t):
    best, found, _ = model_search(materialize(training_rows(t), "rows"), "logistic_regression", {"regParam": Range(1e-3, 1.0, log=True), "elasticNetParam": Range(0.0, 1.0)},
                                  trials=8, batch=4)
    settings = [F.lit(float(best[n])).alias(n) for n in sorted(best)]
    return t.phishing.agg(F.count(F.lit(1)).alias("rows")).select(*settings, F.lit(float(found)).alias("f1"), "rows")


@query("voting_scores", "M20 M23")
def voting_scores(t):
    train, test = M.split_tables(training_rows(t), IDS)
    estimators = {n: M.make_model(n) for n in ("logistic_regression", "naive_bayes", "decision_tree")}
    models = {n: e.fit(train) for n, e in estimators.items()}
    weights = list(M.vote_weights(M.cv_f1(train, estimators, IDS)).values())
    names = [f"score_{n}" for n in models]
    rows = M.base_scores(models, test)
    return rows.select("row_id", "label", M.soft_vote(names, weights).alias("soft"), M.hard_vote(names, weights).alias("hard"))


_SOFT = "(statistical*0.5e0 + text*0.3e0 + visual*0.2e0)"


@query("weighted_votes", "M20", with_views("traffic model_scores", f"""SELECT id, round({_SOFT}, 8) AS soft, CAST((CASE WHEN statistical > 0.5 THEN 0.5e0 ELSE 0 END + CASE WHEN text > 0.5 THEN 0.3e0 ELSE 0 END
 + CASE WHEN visual > 0.5 THEN 0.2e0 ELSE 0 END)*2 > 1 AS INT) AS hard FROM model_scores WHERE statistical IS NOT NULL AND text IS NOT NULL AND visual IS NOT NULL"""))
def weighted_votes(t):
    names, w = ["statistical", "text", "visual"], [0.5, 0.3, 0.2]
    rows = t.model_scores.dropna(subset=names)
    return rows.select("id", F.round(M.soft_vote(names, w), 8).alias("soft"), M.hard_vote(names, w).alias("hard"))


@query("stacked_scores", "M21")
def stacked_scores(t):
    train, test = M.split_tables(training_rows(t), IDS)
    bases = {"logistic_regression": M.make_model("logistic_regression"), "decision_tree": M.make_model("decision_tree")}
    return M.stack(train, bases, IDS, folds=5).score(test).select("row_id", "label", "score", "y_pred")


@query("blended_scores", "M22")
def blended_scores(t):
    train, test = M.split_tables(training_rows(t), IDS)
    bases = {"logistic_regression": M.make_model("logistic_regression"), "decision_tree": M.make_model("decision_tree")}
    return M.blend(train, bases, IDS).score(test).select("row_id", "label", "score", "y_pred")


@query("cross_validation_metrics", "M24")
def cross_validation_metrics(t):
    return M.cv_metrics(training_rows(t), M.make_model("naive_bayes"), IDS)


@query("feature_importances", "M26")
def feature_importances(t):
    fitted, _, _ = trained(t, "decision_tree")
    return M.feature_importance(fitted, FEATURES, t.spark)


@query("row_contributions", "M27 T6")
def row_contributions(t):
    fitted, _, test = trained(t)
    rows = M.linear_contributions(fitted, test, FEATURES, limit=5)
    return rows.select("row_id", "base_value", F.posexplode("top_features").alias("pos", "f")).select("row_id", "base_value", "pos", "f.feature", "f.contribution")


@query("boosted_stump_scores", "M16 M15")
def boosted_stump_scores(t):
    """Held-out scores of the boosting family."""
    fitted, _, test = trained(t, "ada_boost", rounds=20, rate=1.0)
    return M.score(fitted, test).select("row_id", "label", "score", "y_pred")


@query("tree_row_contributions", "M27 T6")
def tree_row_contributions(t):
    """Contributions of every feature to the score of a forest; they add up to the score less the base value."""
    train, test = M.split_tables(training_rows(t), IDS)
    fitted = M.make_model("random_forest", trees=20, depth=8).fit(train)
    rows = tree_contributions(fitted, M.score(fitted, test), FEATURES, limit=5)
    return rows.select("row_id", "score", "base_value", "margin", F.posexplode("top_features").alias("pos", "f")).select(
        "row_id", "score", "base_value", "margin", "pos", "f.feature", "f.contribution")


@query("permutation_importances", "M27")
def permutation_importances(t):
    fitted, _, test = trained(t)
    return M.permutation_importance(fitted, test, FEATURES, IDS)


_CONTR = {"a": "statistical - 0.5e0", "b": "(text - 0.5e0)*2", "c": "0.25e0 - visual", "d": "0.1e0"}


@query("top_contributions", "T6", with_views("traffic model_scores", ", l AS (" + " UNION ALL ".join(
    f"SELECT id, '{n}' AS feature, {e} AS contribution FROM model_scores WHERE statistical IS NOT NULL AND text IS NOT NULL AND visual IS NOT NULL" for n, e in _CONTR.items())
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS k FROM l) SELECT id, CAST(k - 1 AS INT) AS pos, feature, round(contribution, 6) + 0 AS contribution FROM r WHERE k <= 3"))
def top_contributions(t):
    rows = t.model_scores.dropna().withColumn("c", F.array(
        F.col("statistical") - 0.5, (F.col("text") - 0.5) * 2, 0.25 - F.col("visual"), F.lit(0.1)))
    top = E.top_contributions(rows, list(_CONTR), "c", 3)
    return top.select("id", F.posexplode("top_features").alias("pos", "f")).select("id", "pos", "f.feature", (F.round("f.contribution", 6) + F.lit(0.0)).alias("contribution"))


@query("isolation_forest_scores", "M28")
def isolation_forest_scores(t):
    rows = training_rows(t)
    forest = A.IsolationForest.fit(rows, "features", IDS)
    return forest.score(rows, "features").select("row_id", "anomaly_score", "label")


@query("reconstruction_errors", "M30")
def reconstruction_errors(t):
    train, test = M.split_tables(connection_training(t), ["flow_no", "flow_line"])
    return M.reconstruction(train, test, components=8).select("flow_no", "flow_line", "error", "threshold", "label")


@query("encoder_reconstruction_errors", "M30")
def encoder_reconstruction_errors(t):
    """Held-out errors of a non-linear encoder of the training part."""
    train, test = M.split_tables(connection_training(t), ["flow_no", "flow_line"])
    return G.encoder_errors(train, test, hidden=(32, 16, 8)).select("flow_no", "flow_line", "error", "threshold", F.col("label").alias("anomaly"))


@query("one_class_scores", "M28")
def one_class_scores(t):
    """Held-out scores of a one-class machine of the training part."""
    train, test = M.split_tables(training_rows(t), IDS)
    return K.one_class(train, test).select("row_id", "label", "score", "anomaly")


@query("kernel_machine_scores", "M15 M16")
def kernel_machine_scores(t):
    """Held-out predictions of the kernel family."""
    fitted, _, test = trained(t, "kernel_svc")
    return M.score(fitted, test).select("row_id", "label", "score", "y_pred")


@query("encoder_ensemble_scores", "M31 M32 M33 M34")
def encoder_ensemble_scores(t):
    return A.ensemble_scores(t.packets).select("pkt_no", "rmse", "label", "probability", "is_training")


@query("error_threshold_labels", "M33 M34", with_views("traffic", ", q AS (SELECT quantile_cont(processing_time_ms, 0.99) AS c FROM traffic) SELECT id, CASE WHEN processing_time_ms > c THEN -1 ELSE 1 END AS label, round(least(1e0, processing_time_ms/(c*2)), 6) AS probability FROM traffic, q"))
def error_threshold_labels(t):
    cut = A.percentile_value(t.traffic, "processing_time_ms", 99.0).first()["threshold"]
    return A.threshold_labels(t.traffic, "processing_time_ms", cut).select("id", "label", F.round("probability", 6).alias("probability"))


def flow_sample_table(t):
    """Samples of at most 10 packets or 10 seconds, as one vector each, and whether they attack the victim."""
    victims = t.spark.sql("SELECT '172.16.0.2' AS ip")
    m = O.sample_matrices(O.assign_samples(t.packets, 10, 10.0), 10, victims=victims)
    return m.select("flow_key", "sample_no", "packets", "start_time", "end_time", array_to_vector(F.flatten("matrix")).alias("features"),
                    F.col("label").cast("double").alias("label"))


def sample_model(t):
    """A classifier of flow samples, fitted on the training part of a split by sample."""
    train, _ = M.split_tables(materialize(flow_sample_table(t), "samples"), ["flow_key", "sample_no"], 0.2)
    return M.make_model("logistic_regression").fit(train)


@query("flow_sample_scores", "M35")
def flow_sample_scores(t):
    """Scores of the held-out samples."""
    _, test = M.split_tables(materialize(flow_sample_table(t), "samples"), ["flow_key", "sample_no"], 0.2)
    return M.score(sample_model(t), test).select("flow_key", "sample_no", "label", "score", "y_pred")


@query("sample_network_scores", "M35")
def sample_network_scores(t):
    """Scores of the held-out samples by a convolution over their packets."""
    train, test = M.split_tables(materialize(flow_sample_table(t), "samples"), ["flow_key", "sample_no"], 0.2)
    net = G.SampleNet(10, 11)
    flat, _ = G.train(train, net, label="label", steps=60, rate=0.02)
    return G.outputs(test, net, flat).withColumn("y_pred", (F.col("score") > 0.5).cast("int")).select("flow_key", "sample_no", "label", "score", "y_pred")


@query("page_text_scores", "M36")
def page_text_scores(t):
    """Scores of all texts by a model that has not seen the held-out fifth."""
    texts = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    marked = materialize(sampling.mark_fraction(texts, ["doc_id"], fraction=0.2, seed=42, out="held_out"), "texts")
    fitted = M.text_pipeline().fit(marked.where("label IS NOT NULL AND NOT held_out"))
    return M.score_texts(fitted, marked).select("doc_id", "label", "held_out", "score", "y_pred")
