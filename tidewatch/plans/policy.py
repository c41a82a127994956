"""Fusion, response policies, rewards and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evals as E
from tidewatch.operators import policy as P
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.quality import ATTACKS_SQL, attack_rows
from tidewatch.plans.registry import query


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


_LEVELS = "CASE WHEN risk_score >= 0.95 THEN 'critical' WHEN risk_score >= 0.8 THEN 'high' WHEN risk_score >= 0.6 THEN 'medium' WHEN risk_score >= 0.4 THEN 'low' ELSE 'safe' END"
_ACTS = "CASE WHEN risk_score >= 0.95 THEN 'block' WHEN risk_score >= 0.8 THEN 'challenge' WHEN risk_score >= 0.6 THEN 'alert' WHEN risk_score >= 0.4 THEN 'log' ELSE 'allow' END"


@query("confidence_policy", "R8 R10 E2 D4", with_views("traffic", f"SELECT id, risk_score AS confidence, {_LEVELS} AS threat_level, {_ACTS} AS response, risk_score > 0.2 AS is_threat, 'risk' AS model_name FROM traffic"))
def confidence_policy(t):
    from tidewatch.operators.scorers import ScorerBook

    book = ScorerBook()
    book.register("risk", F.col("risk_score"))
    return book.detect(t.traffic).select("id", "confidence", "threat_level", "response", "is_threat", "model_name")


@query("fallback_policy", "R9 E2", with_views("traffic", "SELECT id, 0e0 AS confidence, 'safe' AS threat_level, 'allow' AS response, false AS is_threat, 'fallback' AS model_name FROM traffic"))
def fallback_policy(t):
    from tidewatch.operators.scorers import ScorerBook

    return ScorerBook().detect(t.traffic, "absent").select("id", "confidence", "threat_level", "response", "is_threat", "model_name")


def _layer_sql(second: str, rest: str) -> str:
    return f"""SELECT id, CASE WHEN threat_type='benign' THEN 'allow' WHEN risk_level='critical' THEN 'block' WHEN {second} THEN 'block' ELSE {rest} END AS response,
 CASE WHEN threat_type='benign' THEN 'none' WHEN risk_level='critical' THEN 'server_default' WHEN {second} THEN 'second_layer' ELSE 'none' END AS blocked_by FROM traffic"""


_COIN = "CASE WHEN id % 2 = 0 THEN 'challenge' ELSE 'alert' END"
_SECOND = {"strict": "true", "high": "risk_level IN ('high','medium')", "medium": "risk_level = 'high'", "low": "false"}
_LOG = "'log'"
_LAYERS = " UNION ALL ".join(f"SELECT '{k}' AS level, * FROM ({_layer_sql(s, _LOG if k == 'low' else _COIN)})" for k, s in _SECOND.items())


@query("layered_responses", "R11", with_views("traffic", _LAYERS))
def layered_responses(t):
    rows = t.traffic.withColumn("level", F.explode(F.array(*map(F.lit, _SECOND))))
    return P.layered_response(rows, F.col("level"), coin=F.col("id") % 2).select("level", "id", "response", "blocked_by")


@query("layer_counters", "R12", with_views("traffic", """SELECT count(*) FILTER (threat_type<>'benign' AND risk_level='critical') AS server_blocked,
 count(*) FILTER (threat_type<>'benign' AND risk_level='high') AS second_layer_blocked, CAST(0 AS BIGINT) AS threats_logged FROM traffic"""))
def layer_counters(t):
    return P.layer_counters(P.layered_response(t.traffic, "medium"))


_W = {"statistical": 0.4, "text": 0.35, "visual": 0.25}


def _fuse_sql(w: dict) -> str:
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    top = " + ".join(f"coalesce({k}*{v!r}e0, 0)" for k, v in w.items())
    low = " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {v!r}e0 ELSE 0 END" for k, v in w.items())
    n = " + ".join(f"CAST({k} IS NOT NULL AS INT)" for k in w)
    return f", fu AS (SELECT *, coalesce(({top})/nullif({low}, 0), 0.5e0) AS s, {n} AS n_models FROM model_scores) "


_FUSED = """SELECT id, round(s, 8) AS fused_score, n_models, CASE WHEN s >= 0.8 THEN '危险 (Dangerous)' WHEN s >= 0.6 THEN '可疑 (Suspicious)' WHEN s >= 0.3 THEN '低风险 (Low Risk)' ELSE '安全 (Safe)' END AS fused_level,
 s >= 0.5 AS is_phishing FROM fu"""
_FCOLS = ["n_models", "fused_level", "is_phishing"]


@query("fused_scores", "R13 R14", with_views("traffic model_scores", _fuse_sql(_W) + _FUSED))
def fused_scores(t):
    return P.fuse(t.model_scores).select("id", F.round("fused_score", 8).alias("fused_score"), *_FCOLS)


@query("reweighted_scores", "R15", with_views("traffic model_scores", _fuse_sql({"statistical": 0.5, "text": 0.3, "visual": 0.7}) + _FUSED))
def reweighted_scores(t):
    weights = P.normalized({"statistical": 0.5, "text": 0.3, "visual": 0.2}, visual=0.7)
    return P.fuse(t.model_scores, weights).select("id", F.round("fused_score", 8).alias("fused_score"), *_FCOLS)


SCORERS = {"statistical": ("anomaly", F.col), "text": ("classification", F.col), "visual": ("classification", F.col)}


def scorers():
    return {n: (kind, make(n)) for n, (kind, make) in SCORERS.items()}


_POS = "[s FOR s IN [statistical, text, visual] IF s > 0]"


@query("detector_votes", "R16 R18 D22", with_views("traffic model_scores", f"""SELECT id, round(coalesce(list_max({_POS}), 0), 6) AS vote_max,
 round(coalesce(list_avg({_POS}), 0), 6) AS vote_avg, round(coalesce(len([s FOR s IN [statistical, text, visual] IF s > 0.5])*1e0/nullif(len([s FOR s IN [statistical, text, visual] IF s IS NOT NULL]), 0), 0), 6) AS vote_majority FROM model_scores"""))
def detector_votes(t):
    rows = P.run_all(t.model_scores, scorers())
    return rows.select("id", *[F.round(P.vote_score(F.col("results"), s), 6).alias(f"vote_{s}") for s in ("max", "avg", "majority")])


_CASC = ", ca AS (SELECT id, statistical AS a, CASE WHEN coalesce(statistical, 0) > 0.3 THEN text END AS b, CASE WHEN coalesce(statistical, 0) > 0.3 THEN visual END AS c FROM model_scores), cb AS (SELECT *, [s FOR s IN [a, b, c] IF s IS NOT NULL] AS r, coalesce(list_max([s FOR s IN [a,b,c] IF s > 0]), 0) AS s FROM ca) "


@query("cascade_decisions", "R17 R19", with_views("traffic model_scores", _CASC + """SELECT id, round(s, 6) AS threat_score, s >= 0.5 AS is_threat, CASE WHEN s >= 0.5 THEN 'anomaly' ELSE 'normal' END AS threat_type,
 CASE WHEN len(r) = 0 THEN 'ALLOW' WHEN s > 0.7 THEN 'BLOCK' WHEN s >= 0.5 THEN 'ALERT' ELSE 'ALLOW' END AS final_action,
 round(CASE WHEN len(r) = 0 THEN 1e0 WHEN s > 0.3 AND s < 0.7 THEN 1e0 - abs(s - 0.5e0)*2 ELSE 0.9e0 END, 6) AS confidence, len(r) AS detectors FROM cb"""))
def cascade_decisions(t):
    rows = P.decide(P.cascade(t.model_scores, scorers()))
    return rows.select("id", *r6("threat_score", "confidence"), "is_threat", "threat_type", "final_action", F.size("results").cast("bigint").alias("detectors"))


@query("stage_decisions", "R20 R21", with_views("traffic model_scores", """, z AS (SELECT id, statistical, text, coalesce(statistical, 0) AS risk FROM model_scores)
SELECT id, (coalesce(statistical, 0) > 0.5 OR coalesce(text, 0) > 0.5) AS any_threat, round(coalesce(list_max([s FOR s IN [statistical, text, 0e0] IF s > 0]), 0), 6) AS top_score,
 CASE WHEN risk > 0.8 THEN 'BLOCK' WHEN risk > 0.5 THEN 'CHALLENGE' WHEN risk > 0.3 THEN 'ALERT' ELSE 'ALLOW' END AS last_action,
 CAST(1 + CAST(statistical IS NOT NULL AS INT) + CAST(text IS NOT NULL AS INT) AS INT) AS stage_count FROM z"""))
def stage_decisions(t):
    risk = F.coalesce("statistical", F.lit(0.0))
    results = P.stages(
        P.stage("statistical", "anomaly", F.col("statistical"), F.col("statistical") > 0.5),
        P.stage("text", "classification", F.col("text"), F.col("text") > 0.5),
        P.stage("policy", "decision", F.lit(0.0), F.lit(False), action=P.best_action(risk)))
    rows = P.stage_decision(t.model_scores.withColumn("results", results))
    return rows.select("id", "any_threat", *r6("top_score"), "last_action", "stage_count")


@query("combined_model_votes", "R25", with_views("traffic model_scores", """SELECT id,
 coalesce(greatest(statistical, text, visual) >= 0.5, false) AS vote_any,
 len([s FOR s IN [statistical, text, visual] IF s >= 0.5])*2 > len([s FOR s IN [statistical, text, visual] IF s IS NOT NULL]) AS vote_majority,
 coalesce((coalesce(statistical*2e0,0)+coalesce(text,0)+coalesce(visual,0))/nullif(CASE WHEN statistical IS NULL THEN 0e0 ELSE 2e0 END+CASE WHEN text IS NULL THEN 0e0 ELSE 1e0 END+CASE WHEN visual IS NULL THEN 0e0 ELSE 1e0 END,0) >= 0.5, false) AS vote_weighted FROM model_scores"""))
def combined_model_votes(t):
    s = F.array("statistical", "text", "visual")
    return t.model_scores.select("id", P.combine_votes(s, "any").alias("vote_any"), P.combine_votes(s, "majority").alias("vote_majority"),
                                 P.combine_votes(s, "weighted", weights=[2.0, 1.0, 1.0]).alias("vote_weighted"))


def _reward_sql(table: str) -> str:
    rows = ", ".join(f"({a}, {h}e0, {m}e0)" for a, h, m in P.REWARDS[table])
    return f"rw_{table}(action, att, nor) AS (VALUES {rows})"


@query("decision_rewards", "R22 R23", with_views("traffic decisions", f", {_reward_sql('basic')}, {_reward_sql('extended')} " + """
SELECT seq, d.action, is_attack, CASE WHEN is_attack THEN b.att ELSE b.nor END AS basic_reward, CASE WHEN is_attack THEN e.att ELSE e.nor END AS reward,
 CASE WHEN is_attack THEN d.action IN (1,6,2,4,5) ELSE d.action IN (0,3) END AS correct FROM decisions d JOIN rw_basic b USING (action) JOIN rw_extended e USING (action)"""))
def decision_rewards(t):
    basic = P.with_reward(t.decisions, "basic").withColumnRenamed("reward", "basic_reward")
    rows = P.with_reward(basic, "extended").withColumn("correct", P.is_correct(F.col("action"), F.col("is_attack")))
    return rows.select("seq", "action", "is_attack", "basic_reward", "reward", "correct")


_STREAK = ", " + _reward_sql("configurable") + """,
c1 AS (SELECT *, CASE WHEN is_attack THEN action IN (1,6,2,4,5) ELSE action IN (0,3) END AS correct FROM decisions),
c2 AS (SELECT *, row_number() OVER (ORDER BY seq) - row_number() OVER (PARTITION BY correct ORDER BY seq) AS isl FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY correct, isl ORDER BY seq) AS streak FROM c2),
c4 AS (SELECT c3.*, (CASE WHEN is_attack THEN att ELSE nor END) * CASE WHEN is_attack AND threat_score > 0.7 THEN 1.5e0 ELSE 1e0 END
  + CASE WHEN streak > 3 THEN CASE WHEN correct THEN 1e0 ELSE -2e0 END ELSE 0e0 END AS reward FROM c3 JOIN rw_configurable USING (action))"""


@query("decision_streaks", "W13", with_views("traffic decisions", _STREAK + " SELECT seq, correct, streak FROM c3"))
def decision_streaks(t):
    return P.with_streaks(t.decisions).select("seq", "correct", F.col("streak").cast("bigint").alias("streak"))


@query("shaped_rewards", "W14 R22", with_views("traffic decisions", _STREAK + " SELECT seq, round(reward, 6) AS reward, round(sum(reward) OVER (ORDER BY seq), 4) AS total_reward FROM c4"))
def shaped_rewards(t):
    return P.shaped_rewards(t.decisions).select("seq", *r6("reward"), F.round("total_reward", 4).alias("total_reward"))


@query("reward_summary", "W14", with_views("traffic decisions", _STREAK + " SELECT round(sum(reward), 4) AS total_rewards, count(*) AS episode_count, round(avg(reward), 6) AS avg_reward FROM c4"))
def reward_summary(t):
    return P.reward_summary(P.shaped_rewards(t.decisions)).select(F.round("total_rewards", 4).alias("total_rewards"), "episode_count", *r6("avg_reward"))


_RATIO = """round((tp+tn)*1e0/greatest(tp+tn+fp+fn,1), 6) AS accuracy, round(coalesce(tp*1e0/nullif(tp+fp,0),0), 6) AS precision, round(coalesce(tp*1e0/nullif(tp+fn,0),0), 6) AS recall,
 round(coalesce(2e0*tp/nullif(2*tp+fp+fn,0),0), 6) AS f1, round(coalesce(fp*1e0/nullif(fp+tn,0),0), 6) AS fpr, round(coalesce(fn*1e0/nullif(fn+tp,0),0), 6) AS fnr"""
_RNAMES = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]
_CONF = "count(*) FILTER (y_true=1 AND y_pred=1) AS tp, count(*) FILTER (y_true=0 AND y_pred=0) AS tn, count(*) FILTER (y_true=0 AND y_pred=1) AS fp, count(*) FILTER (y_true=1 AND y_pred=0) AS fn"


@query("policy_outcomes", "R24 A15", with_views("traffic decisions", f", o AS (SELECT count(*) FILTER (is_attack AND action IN (1,6)) AS tp, count(*) FILTER (NOT is_attack AND action NOT IN (1,6)) AS tn, count(*) FILTER (NOT is_attack AND action IN (1,6)) AS fp, count(*) FILTER (is_attack AND action NOT IN (1,6)) AS fn FROM decisions) SELECT tp, tn, fp, fn, {_RATIO} FROM o"))
def policy_outcomes(t):
    return E.ratios(P.policy_outcomes(t.decisions)).select("tp", "tn", "fp", "fn", *r6(*_RNAMES))


@query("classification_metrics", "A15", with_views("traffic predictions", f", o AS (SELECT {_CONF} FROM predictions) SELECT tp, tn, fp, fn, {_RATIO} FROM o"))
def classification_metrics(t):
    return E.classification_metrics(t.predictions).select("tp", "tn", "fp", "fn", *r6(*_RNAMES))


@query("confusion_matrix", "A16", with_views("traffic predictions", "SELECT y_true, y_pred, count(*) AS cnt, round(count(*)*1e0/(SELECT count(*) FROM predictions), 6) AS share FROM predictions GROUP BY 1, 2"))
def confusion_matrix(t):
    return E.confusion_matrix(t.predictions).withColumn("share", F.round("share", 6))


@query("top_attack_types", "A17", f"WITH {ATTACKS_SQL} SELECT attack_type, count(*) AS cnt FROM attacks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_attack_types(t):
    return E.top_labels(attack_rows(t), "attack_type")


@query("latency_profile", "A18", with_views("traffic", """, s AS (SELECT processing_time_ms AS v, row_number() OVER (ORDER BY processing_time_ms) - 1 AS i, count(*) OVER () AS n FROM traffic)
SELECT min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean_value, round(median(v), 6) AS median_value,
 max(v) FILTER (i = floor(n*0.95e0)) AS p95, max(v) FILTER (i = floor(n*0.99e0)) AS p99 FROM s"""))
def latency_profile(t):
    return E.latency_profile(t.traffic, "processing_time_ms").select("min_value", "max_value", *r6("mean_value", "median_value"), "p95", "p99")


@query("latency_profile_approx", "A18")
def latency_profile_approx(t):
    return E.latency_profile_approx(t.traffic, "processing_time_ms")


@query("prediction_counters", "A26", with_views("traffic predictions", "SELECT count(*) AS total, sum(y_pred)::BIGINT AS threats, count(*) FILTER (y_true = y_pred) AS correct, count(*) AS labelled, round(count(*) FILTER (y_true = y_pred)*1e0/count(*), 6) AS accuracy FROM predictions"))
def prediction_counters(t):
    return E.prediction_counters(t.predictions).withColumn("accuracy", F.round("accuracy", 6))


_MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model, dest_ip AS data_set, CAST(threat_type <> 'benign' AS INT) AS y_true, CAST({m} >= 0.5 AS INT) AS y_pred FROM model_scores JOIN traffic USING (id) WHERE {m} IS NOT NULL" for m in _W)


def model_metrics(t):
    scores = t.model_scores.join(t.traffic.select("id", "dest_ip", (F.col("threat_type") != "benign").cast("int").alias("y_true")), "id")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in _W]))
    rows = scores.select(F.col("dest_ip").alias("data_set"), "y_true", cells.alias("e")).where("e.score IS NOT NULL")
    return E.classification_metrics(rows.select("e.model", "data_set", "y_true", (F.col("e.score") >= 0.5).cast("int").alias("y_pred")), ["model", "data_set"])


@query("model_leaderboard", "T8", with_views("traffic model_scores", f", p AS ({_MODELS}), o AS (SELECT model, data_set, {_CONF} FROM p GROUP BY 1, 2), m AS (SELECT model, (tp+tn)*1e0/(tp+tn+fp+fn) AS accuracy, coalesce(2e0*tp/nullif(2*tp+fp+fn,0),0) AS f1 FROM o) SELECT model, round(avg(f1), 6) AS avg_f1, round(avg(accuracy), 6) AS avg_accuracy, count(*) AS data_sets FROM m GROUP BY 1"))
def model_leaderboard(t):
    return E.leaderboard(model_metrics(t)).select("model", *r6("avg_f1", "avg_accuracy"), "data_sets")


@query("best_model", "T7", with_views("traffic model_scores", f", p AS ({_MODELS}), o AS (SELECT model, data_set, {_CONF} FROM p GROUP BY 1, 2), m AS (SELECT model, coalesce(2e0*tp/nullif(2*tp+fp+fn,0),0) AS f1 FROM o) SELECT model, round(avg(f1), 6) AS score FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def best_model(t):
    scores = model_metrics(t).select("model", F.col("f1").alias("score"))
    ranked = scores.groupBy("model").agg(F.avg("score").alias("score")).orderBy(F.desc("score"), "model").limit(1)
    return ranked.select("model", *r6("score"))


@query("staged_pipeline_decisions", "E3 E4", with_views("traffic model_scores", """, z AS (SELECT id, statistical, text, coalesce(statistical, 0) AS risk FROM model_scores)
SELECT id, (coalesce(statistical, 0) > 0.4 OR coalesce(text, 0) > 0.5 OR risk > 0.8) AS any_threat, round(greatest(coalesce(statistical, 0), coalesce(text, 0)), 6) AS top_score,
 CASE WHEN risk > 0.8 THEN 'BLOCK' WHEN risk > 0.5 THEN 'CHALLENGE' WHEN risk > 0.3 THEN 'ALERT' ELSE 'ALLOW' END AS last_action FROM z"""))
def staged_pipeline_decisions(t):
    from tidewatch.operators.scorers import StageBuilder

    risk = F.coalesce("statistical", F.lit(0.0))
    pipeline = (
        StageBuilder().add("encoder_ensemble", "errors", F.col("statistical"), threshold=0.4)
        .add("ml", "words", F.col("text")).add("policy", "policy", F.lit(0.0), action=P.best_action(risk)).build())
    rows = P.stage_decision(pipeline.fit(t.model_scores).transform(t.model_scores))
    return rows.select("id", "any_threat", *r6("top_score"), "last_action")
