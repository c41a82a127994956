"""Data quality, splits, imputation, drift and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import labels as L
from tidewatch.operators import quality as Q
from tidewatch.operators import sampling as S
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import query
from tidewatch.schemas import PHISHING_FEATURES as FEATURES

_Q = [f'"{c}"' for c in FEATURES]
ABSENT = ["SFH", "Iframe"]
PRESENT = [c for c in FEATURES if c not in ABSENT]


def _gappy(t):
    """The feature table without two required columns and with two extra ones."""
    return t.phishing.drop(*ABSENT)


def _profile_sql(c: str, status: str) -> str:
    q = f'"{c}"'
    return f"""SELECT '{c}' AS feature, '{status}' AS status, true AS is_numeric, count(*) - count({q}) AS null_count,
 round((count(*) - count({q}))*100e0/count(*), 2) AS null_percent, (count(*) - count({q}))*100e0/count(*) > 10 AS many_nulls,
 CAST(min({q}) AS DOUBLE) AS min_value, CAST(max({q}) AS DOUBLE) AS max_value, min({q}) < -10 OR max({q}) > 10 AS out_of_range FROM phishing"""


@query("validation_report", "U1 U3 A19 A20 M9", with_views("phishing", " UNION ALL ".join(
    [_profile_sql(c, "present") for c in PRESENT] + [_profile_sql(c, "extra") for c in ("row_id", "Result")]
    + [f"SELECT '{c}', 'missing', false, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), false, NULL, NULL, false" for c in ABSENT])))
def validation_report(t):
    return Q.validation_report(_gappy(t), FEATURES)


@query("validation_verdict", "M9 U3", with_views("phishing", "SELECT count(*) < 0 AS all_present, true AS all_numeric, false AS is_valid FROM phishing"))
def validation_verdict(t):
    return Q.is_valid(Q.validation_report(_gappy(t), FEATURES))


@query("imputation_advice", "A21", with_views("phishing", f"""SELECT round(p, 2) AS missing_percentage, strategy, CAST(priority AS INT) AS priority FROM
 (SELECT ({' + '.join(f'count(*) - count({q})' for q in _Q)}) * 100e0 / (count(*) * 30) AS p FROM phishing),
 (VALUES (1, 'knn'), (2, 'median')) v(priority, strategy) WHERE p >= 5 AND p < 15"""))
def imputation_advice(t):
    return Q.imputation_advice(t.phishing.select(*FEATURES))


@query("feature_catalogue", "M10", with_views("phishing", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, 'integer' AS type, count(*) FILTER (\"{c}\" IN (-1,0,1)) AS usual_values, count(\"{c}\") AS filled FROM phishing"
    for i, c in enumerate(FEATURES))))
def feature_catalogue(t):
    return Q.feature_catalogue(t.phishing, FEATURES)


@query("class_balance", "A22", with_views("phishing", """SELECT "Result" AS label, count(*) AS cnt,
 (SELECT max(c)*1e0/min(c) FROM (SELECT count(*) AS c FROM phishing GROUP BY "Result")) AS imbalance_ratio FROM phishing GROUP BY 1"""))
def class_balance(t):
    return L.class_balance(t.phishing, "Result")


@query("required_columns", "F6 F7 M4 M5", with_views("phishing", "SELECT row_id, " + ", ".join(
    f"0 AS \"{c}\"" if c in ABSENT else f"coalesce(\"{c}\", 0) AS \"{c}\"" for c in FEATURES)
    + ", CASE WHEN \"Result\" = -1 THEN 0 ELSE \"Result\" END AS \"Result\" FROM phishing"))
def required_columns(t):
    full, _ = Q.add_missing_columns(_gappy(t), FEATURES)
    filled = Q.impute(full.withColumn("Result", L.zero_one()), FEATURES, "constant")
    return L.pick_required(filled, [*FEATURES, "Result"], keep=["row_id"])


def _fill_sql(agg: str) -> str:
    return with_views("phishing", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({agg.format(c=chr(34) + c + chr(34))}, 6) AS fill FROM phishing" for c in FEATURES))


@query("imputation_means", "M6", _fill_sql("avg({c})"))
def imputation_means(t):
    return Q.fill_values(t.phishing, FEATURES, "mean").withColumn("fill", F.round("fill", 6))


@query("imputation_medians", "M6", _fill_sql("median({c})"))
def imputation_medians(t):
    return Q.fill_values(t.phishing, FEATURES, "median").withColumn("fill", F.round("fill", 6))


@query("imputation_modes", "M6", with_views("phishing", " UNION ALL ".join(
    f"(SELECT '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS fill FROM phishing WHERE \"{c}\" IS NOT NULL GROUP BY \"{c}\" ORDER BY count(*) DESC, \"{c}\" LIMIT 1)" for c in FEATURES)))
def imputation_modes(t):
    return Q.fill_values(t.phishing, FEATURES, "most_frequent")


@query("mean_imputed_rows", "M6 M8", with_views("phishing", "SELECT row_id, " + ", ".join(
    f"round(coalesce(\"{c}\", (SELECT avg(\"{c}\") FROM phishing)), 6) AS \"{c}\"" for c in FEATURES) + " FROM phishing"))
def mean_imputed_rows(t):
    filled, _ = Q.impute_report(t.phishing, FEATURES, "mean", keep=["row_id"])
    return filled.select("row_id", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("imputation_report", "M8", with_views("phishing", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {'true' if c in ABSENT else 'false'} AS added, {'count(*) - count(*)' if c in ABSENT else f'count(*) - count({chr(34)}{c}{chr(34)})'} AS missing_count, 'median' AS strategy FROM phishing" for c in FEATURES)))
def imputation_report(t):
    return Q.impute_report(_gappy(t), FEATURES, "median")[1]


_KS = """,
vals AS ({vals}),
sz AS (SELECT feature, sum(a) AS na, sum(b) AS nb FROM vals GROUP BY feature),
cnt AS (SELECT feature, v, sum(a) AS a, sum(b) AS b FROM vals GROUP BY feature, v),
run AS (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY v) AS ca, sum(b) OVER (PARTITION BY feature ORDER BY v) AS cb FROM cnt),
gap AS (SELECT feature, max(abs(ca*1e0/na - cb*1e0/nb)) AS gap, any_value(na) AS na, any_value(nb) AS nb FROM run JOIN sz USING (feature) GROUP BY feature),
lam AS (SELECT *, sqrt((na*1e0*nb)/(na+nb))*gap AS l FROM gap),
pv AS (SELECT feature, gap, na, nb, CASE WHEN l < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0, 2*list_sum([CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END * exp(-2e0*k*k*l*l) FOR k IN range(1, 101)]))) END AS p FROM lam)
SELECT feature, round(gap, 6) AS gap, CAST(na AS BIGINT) AS n_base, CAST(nb AS BIGINT) AS n_current, round(p, 6) AS p_value, p > 0.05 AS same_distribution FROM pv"""


def _rounded(report):
    return report.withColumn("gap", F.round("gap", 6)).withColumn("p_value", F.round("p_value", 6))


@query("feature_drift", "W15 M11", with_views("phishing", _KS.format(vals=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS v, CAST(row_id % 5 <> 0 AS INT) AS a, CAST(row_id % 5 = 0 AS INT) AS b FROM phishing WHERE \"{c}\" IS NOT NULL" for c in [*FEATURES, "Result"]))))
def feature_drift(t):
    held_out = F.col("row_id") % 5 == 0
    return _rounded(Q.drift_report(t.phishing.where(~held_out), t.phishing.where(held_out), [*FEATURES, "Result"]))


@query("exact_feature_drift", "W15 M11")
def exact_feature_drift(t):
    """Exact p-values where the samples are small enough."""
    held_out = F.col("row_id") % 5 == 0
    return _rounded(Q.drift_report(t.phishing.where(~held_out), t.phishing.where(held_out), [*FEATURES, "Result"], exact_rows=Q.EXACT_ROWS))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("measure_drift", "W15 M11", "WITH d AS (SELECT 1)" + _KS.format(vals=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, CAST(l_linestatus = 'O' AS INT) AS a, CAST(l_linestatus <> 'O' AS INT) AS b FROM lineitem" for c in _MEASURES)))
def measure_drift(t):
    opened = F.col("l_linestatus") == "O"
    return _rounded(Q.drift_report(t.lineitem.where(opened), t.lineitem.where(~opened), _MEASURES))


@query("drift_verdict", "M11")
def drift_verdict(t):
    train, test = S.split(t.phishing, ["row_id"])
    return Q.drift_verdict(Q.drift_report(train, test, [*FEATURES, "Result"]))


@query("split_sizes", "M1 S4", with_views("phishing", "SELECT 'test' AS part, CAST(round(count(*)*0.2e0) AS BIGINT) AS cnt FROM phishing UNION ALL SELECT 'train', count(*) - CAST(round(count(*)*0.2e0) AS BIGINT) FROM phishing"))
def split_sizes(t):
    train, test = S.split(t.phishing, ["row_id"])
    parts = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("cnt"))


@query("stratified_split_sizes", "M2", with_views("phishing", """SELECT "Result" AS label, 'test' AS part, CAST(round(count(*)*0.2e0) AS BIGINT) AS cnt FROM phishing GROUP BY 1
 UNION ALL SELECT "Result", 'train', count(*) - CAST(round(count(*)*0.2e0) AS BIGINT) FROM phishing GROUP BY 1"""))
def stratified_split_sizes(t):
    train, test = S.split(t.phishing, ["row_id"], by="Result")
    parts = train.select("Result", F.lit("train").alias("part")).unionByName(test.select("Result", F.lit("test").alias("part")))
    return parts.groupBy(F.col("Result").alias("label"), "part").agg(F.count(F.lit(1)).alias("cnt"))


@query("fixed_size_sample", "M3", with_views("phishing", "SELECT least(count(*), 500) AS cnt, least(count(*), 500) AS distinct_rows FROM phishing"))
def fixed_size_sample(t):
    return S.sample(t.phishing, ["row_id"], 500).agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("row_id").alias("distinct_rows"))


def _sizes(df):
    return df.groupBy(F.col("Result").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))


@query("undersampled_classes", "M13", with_views("phishing", """SELECT "Result" AS label, (SELECT min(c) FROM (SELECT count(*) AS c FROM phishing GROUP BY "Result")) AS cnt FROM phishing GROUP BY 1"""))
def undersampled_classes(t):
    return _sizes(S.balance(t.phishing, "Result", ["row_id"], "undersample"))


@query("oversampled_classes", "M13", with_views("phishing", """SELECT "Result" AS label, (SELECT max(c) FROM (SELECT count(*) AS c FROM phishing GROUP BY "Result")) AS cnt FROM phishing GROUP BY 1"""))
def oversampled_classes(t):
    return _sizes(S.balance(t.phishing, "Result", ["row_id"], "oversample"))


_VALUES = {m: ", ".join(f"('{n}', '{label}')" for label, ns in table.items() for n in ns) for m, table in L.MAPPINGS.items()}
_ATT = "list_value(" + ", ".join(f"'{n}'" for n in [*L.ATTACK_NAMES, "zero_day"]) + ")"
ATTACKS_SQL = f"attacks AS (SELECT l_orderkey AS flow_no, l_linenumber AS flow_line, {_ATT}[CAST(l_orderkey % {len(L.ATTACK_NAMES) + 1} + 1 AS INT)] AS attack_type FROM lineitem)"


def attack_rows(t):
    from tidewatch.sources.views import attacks
    return attacks(t.lineitem, [*L.ATTACK_NAMES, "zero_day"])


@query("attack_categories", "F8 F10 D17", f"""WITH {ATTACKS_SQL}, m(n, label) AS (VALUES {_VALUES['category']})
SELECT attack_type, coalesce(label, 'unknown') AS category, CAST(attack_type <> 'normal' AS INT) AS is_attack, count(*) AS cnt
FROM attacks LEFT JOIN m ON n = attack_type GROUP BY ALL""")
def attack_categories(t):
    mapped = L.map_attacks(attack_rows(t), "category", out="category").withColumn("is_attack", L.is_attack())
    return mapped.groupBy("attack_type", "category", "is_attack").agg(F.count(F.lit(1)).alias("cnt"))


@query("attack_threat_names", "F11", f"""WITH {ATTACKS_SQL}, m(n, label) AS (VALUES {_VALUES['threat']}), s(n, label) AS (VALUES {_VALUES['threat_short']})
SELECT attack_type, coalesce(m.label, 'unknown') AS threat, coalesce(s.label, 'unknown') AS short_threat, count(*) AS cnt
FROM attacks LEFT JOIN m ON m.n = attack_type LEFT JOIN s ON s.n = attack_type GROUP BY ALL""")
def attack_threat_names(t):
    mapped = L.map_attacks(attack_rows(t), "threat", out="threat")
    mapped = L.map_attacks(mapped, "threat_short", out="short_threat")
    return mapped.groupBy("attack_type", "threat", "short_threat").agg(F.count(F.lit(1)).alias("cnt"))


@query("prediction_labels", "F9 A16", with_views("traffic predictions", """SELECT CASE WHEN y_pred = 1 THEN 'Malicious' ELSE 'Safe' END AS verdict, count(*) AS cnt FROM predictions GROUP BY 1"""))
def prediction_labels(t):
    return t.predictions.groupBy(L.verdict_text(F.col("y_pred")).alias("verdict")).agg(F.count(F.lit(1)).alias("cnt"))


@query("schema_checks", "U1 U2 U3 S15", with_views("phishing", """SELECT 'SFH' AS feature, 'missing' AS status, true AS count_ok, false AS numeric_ok, count(*) AS rows FROM phishing
 UNION ALL SELECT 'Iframe', 'missing', true, false, count(*) FROM phishing UNION ALL SELECT 'row_id', 'extra', true, false, count(*) FROM phishing UNION ALL SELECT 'Result', 'extra', true, false, count(*) FROM phishing"""))
def schema_checks(t):
    rows = _gappy(t)
    found = Q.schema_difference(rows, FEATURES).withColumns({
        "count_ok": F.lit(Q.has_column_count(rows, len(FEATURES))), "numeric_ok": F.lit(Q.numeric_columns_ok(rows, FEATURES))})
    return found.withColumn("rows", rows.agg(F.count(F.lit(1))).scalar())
