"""Score fusion, response policies and rewards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.scans import (
    previous_value, running_last, running_totals, with_global_block)
from tidewatch.runtime import BLOCK_ROWS

# --- fixed values: fusion -----------------------------------------------------------------
FUSION_WEIGHTS = {"statistical": 0.4, "text": 0.35, "visual": 0.25}
FUSION_LEVELS = [(0.8, "危险 (Dangerous)"), (0.6, "可疑 (Suspicious)"), (0.3, "低风险 (Low Risk)")]
FUSION_SAFE = "安全 (Safe)"
# --- fixed values: confidence levels and what they trigger ----------------------------------
CONFIDENCE_LEVELS = [(0.95, "critical", "block"), (0.8, "high", "challenge"), (0.6, "medium", "alert"), (0.4, "low", "log")]
# --- fixed values: action codes -------------------------------------------------------------
ACTION_NAMES = ["ALLOW", "BLOCK", "ALERT", "LOG", "CHALLENGE", "RATE_LIMIT", "QUARANTINE"]
# --- fixed values: rewards as (action code, when attack, when normal) -----------------------
REWARDS = {
    # five actions: 0 allow, 1 block, 2 challenge, 3 log, 4 alert
    "basic": [(0, -15.0, 5.0), (1, 10.0, -8.0), (2, 3.0, -2.0), (3, 0.0, 0.0), (4, 5.0, -2.4)],
    # seven actions in the order of ACTION_NAMES
    "extended": [(0, -15.0, 5.0), (1, 10.0, -8.0), (2, 3.0, -1.0), (3, 0.0, 0.0), (4, 2.0, -0.5), (5, 5.0, -3.0), (6, 8.0, -9.6)],
    "configurable": [(0, -15.0, 5.0), (1, 10.0, -8.0), (2, 3.0, -1.0), (3, 0.0, 0.0), (4, 4.0, -2.0), (5, 5.0, -3.0), (6, 10.0, -8.0)],
}
SEVERITY, STREAK_RIGHT, STREAK_WRONG, STREAK_AFTER = 1.5, 1.0, -2.0, 3


def steps(value: Column, bounds: list[tuple], default: str, pick: int = 1) -> Column:
    """First entry whose lower bound the value reaches."""
    out = None
    for b in bounds:
        out = F.when(value >= b[0], b[pick]) if out is None else out.when(value >= b[0], b[pick])
    return out.otherwise(default)


# --- confidence policy ----------------------------------------------------------------------


def detect(df: DataFrame, confidence: str, model_name: str) -> DataFrame:
    """Level, action and verdict of every row. A score above 0.2 is a threat even where
    the level is still safe."""
    c = F.col(confidence)
    return df.withColumns({
        "threat_level": steps(c, CONFIDENCE_LEVELS, "safe"), "response": steps(c, CONFIDENCE_LEVELS, "allow", 2),
        "is_threat": c > 0.2, "confidence": c, "model_name": F.lit(model_name)})


def fallback(df: DataFrame) -> DataFrame:
    """What is answered when no model is registered."""
    return df.withColumns({
        "threat_level": F.lit("safe"), "response": F.lit("allow"), "is_threat": F.lit(False),
        "confidence": F.lit(0.0), "model_name": F.lit("fallback"), "reason": F.lit("no_model_available")})


def best_action(risk: Column) -> Column:
    return F.when(risk > 0.8, "BLOCK").when(risk > 0.5, "CHALLENGE").when(risk > 0.3, "ALERT").otherwise("ALLOW")


LEVELS = ("off", "low", "medium", "high", "strict")


def layered_response(df: DataFrame, level: str | Column, active: bool = True, coin: Column | None = None) -> DataFrame:
    """Two layers: the server blocks critical traffic; the second layer acts by its
    protection level (low, medium, high, strict), given by name or as a column. Undecided
    threats are challenged or alerted by a repeatable coin."""
    if isinstance(level, str):
        if level not in LEVELS:
            raise ValueError(f"unknown protection level {level}")
        level = F.lit(level)
    risk = F.col("risk_level")
    toss = F.pmod(F.xxhash64("id"), F.lit(2)) if coin is None else coin
    second = F.when(level == "strict", True).when(level == "high", risk.isin("high", "medium")).when(level == "medium", risk == "high").otherwise(False)
    logs = level.isin("low", "off") | F.lit(not active)
    rest = F.when(logs, "log").when(toss == 0, "challenge").otherwise("alert")
    by_second = second & F.lit(active)
    benign = F.col("threat_type") == "benign"
    action = F.when(benign, "allow").when(risk == "critical", "block").when(by_second, "block").otherwise(rest)
    blocked_by = (
        F.when(benign, "none").when(risk == "critical", "server_default").when(by_second, "second_layer").otherwise("none"))
    return df.withColumns({"response": action, "blocked_by": blocked_by})


def layer_counters(responses: DataFrame) -> DataFrame:
    by = F.col("blocked_by")
    return responses.agg(
        F.count_if(by == "server_default").alias("server_blocked"),
        F.count_if(by == "second_layer").alias("second_layer_blocked"),
        F.count_if((F.col("threat_type") != "benign") & (F.col("response") == "log")).alias("threats_logged"))


# --- fusion -----------------------------------------------------------------------------------


def normalized(weights: dict[str, float], **changes: float) -> dict[str, float]:
    """Weights with some replaced, scaled to sum to 1."""
    merged = {**weights, **changes}
    total = sum(merged.values())
    return {k: w / total for k, w in merged.items()} if total > 0 else merged


def fuse(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the scores that are present; 0.5 when there is none."""
    w = normalized(weights or FUSION_WEIGHTS)
    parts = [F.coalesce(F.col(k) * v, F.lit(0.0)) for k, v in w.items()]
    used = [F.when(F.col(k).isNotNull(), v).otherwise(0.0) for k, v in w.items()]
    count = [F.col(k).isNotNull().cast("int") for k in w]
    score = F.coalesce(F.try_divide(sum(parts[1:], parts[0]), sum(used[1:], used[0])), F.lit(0.5))
    scored = df.withColumn("fused_score", score).withColumn("n_models", sum(count[1:], count[0]))
    return scored.withColumns({
        "fused_level": steps(F.col("fused_score"), FUSION_LEVELS, FUSION_SAFE), "is_phishing": F.col("fused_score") >= 0.5})


def visual_score(is_phishing: Column, similarity: Column) -> Column:
    """A look-alike counts with its similarity, any other page with the distance to it."""
    return F.when(is_phishing, similarity).otherwise(1 - similarity)


# --- results of several detectors, as array<struct<detector, stage, score, is_threat, ...>> ------


def stage(detector: str, kind: str, score: Column, is_threat: Column, types: Column | None = None,
          action: Column | None = None) -> Column:
    """One detector's result; a missing score means the detector did not run."""
    value = F.struct(
        F.lit(detector).alias("detector"), F.lit(kind).alias("stage"), score.cast("double").alias("score"),
        is_threat.alias("is_threat"), (F.array().cast("array<string>") if types is None else types).alias("types"),
        (F.lit(None).cast("string") if action is None else action).alias("action"))
    return F.when(score.isNotNull(), value)


def stages(*results: Column) -> Column:
    return F.array_compact(F.array(*results))


def _positive(results: Column) -> Column:
    return F.filter(F.transform(results, lambda r: r["score"]), lambda s: s > 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def vote_score(results: Column, strategy: str = "max") -> Column:
    """Largest or mean positive score, or the share of detectors that see a threat."""
    positive = _positive(results)
    if strategy == "max":
        return F.coalesce(F.array_max(positive), F.lit(0.0))
    if strategy == "avg":
        return F.coalesce(F.try_divide(_total(positive), F.size(positive)), F.lit(0.0))
    if strategy == "majority":
        return F.coalesce(F.try_divide(F.size(F.filter(results, lambda r: r["is_threat"])), F.size(results)), F.lit(0.0))
    raise ValueError(f"unknown voting strategy {strategy}")


def _policy_action(results: Column) -> Column:
    return F.try_element_at(F.transform(F.filter(results, lambda r: r["stage"] == "decision"), lambda r: r["action"]), F.lit(-1))


def decide(df: DataFrame, results: str = "results", strategy: str = "max", threshold: float = 0.5) -> DataFrame:
    """Fused score, verdict, threat type, action and confidence of every row."""
    r = F.col(results)
    s = F.col("threat_score")
    is_threat = s >= threshold
    named = F.try_element_at(F.flatten(F.transform(F.filter(r, lambda x: x["is_threat"]), lambda x: x["types"])), F.lit(1))
    strong = F.when(s > 0.7, "BLOCK").otherwise("ALERT")
    action = F.coalesce(_policy_action(r), F.when(is_threat, strong).otherwise("ALLOW"))
    confidence = F.when((s > 0.3) & (s < 0.7), 1.0 - F.abs(s - 0.5) * 2).otherwise(0.9)
    empty = F.size(r) == 0
    return df.withColumn("threat_score", vote_score(r, strategy)).withColumns({
        "is_threat": is_threat, "threat_type": F.when(is_threat, F.coalesce(named, F.lit("anomaly"))).otherwise("normal"),
        "final_action": F.when(empty, "ALLOW").otherwise(action), "confidence": F.when(empty, 1.0).otherwise(confidence)})


def stage_decision(df: DataFrame, results: str = "results") -> DataFrame:
    """Any threat, the largest positive score, the last policy action, and the stage count."""
    r = F.col(results)
    return df.withColumns({
        "any_threat": F.exists(r, lambda x: x["is_threat"]), "top_score": F.coalesce(F.array_max(_positive(r)), F.lit(0.0)),
        "last_action": F.coalesce(_policy_action(r), F.lit("ALLOW")), "stage_count": F.size(r)})


Scorer = Callable[[DataFrame], DataFrame]


def run_all(df: DataFrame, scorers: dict[str, tuple[str, Column]], threshold: float = 0.5) -> DataFrame:
    """Every scorer on every row; ``scorers`` maps a name to (stage, score column)."""
    return df.withColumn("results", stages(*[stage(n, kind, c, c > threshold) for n, (kind, c) in scorers.items()]))


def cascade(df: DataFrame, scorers: dict[str, tuple[str, Column]], trigger: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """Classifiers score a row only when an anomaly detector fires on it or scores above
    ``trigger``. Scores are column expressions, so the untaken branch is not evaluated."""
    first = {n: c for n, (kind, c) in scorers.items() if kind == "anomaly"}
    hot = F.coalesce(F.greatest(*first.values(), F.lit(0.0)), F.lit(0.0)) > min(trigger, threshold)
    results = [stage(n, kind, c if kind == "anomaly" else F.when(hot, c), c > threshold) for n, (kind, c) in scorers.items()]
    return df.withColumn("results", stages(*results))


def cascade_frames(df: DataFrame, hot: Column, scorer: Scorer) -> DataFrame:
    """The same for a scorer that runs Python: only the hot rows reach it. Spark does not
    promise to skip Python functions inside ``when``, hence the explicit split."""
    flag = F.coalesce(hot, F.lit(False))
    return scorer(df.where(flag)).unionByName(df.where(~flag), allowMissingColumns=True)


def combine_votes(scores: Column, strategy: str = "majority", threshold: float = 0.5, weights: list[float] | None = None) -> Column:
    """Verdict of a model combination over its score array."""
    present = F.filter(scores, lambda s: s.isNotNull())
    if strategy == "any":
        return F.coalesce(F.array_max(present) >= threshold, F.lit(False))
    if strategy == "majority":
        return F.size(F.filter(present, lambda s: s >= threshold)) * 2 > F.size(present)
    if strategy == "weighted":
        w = F.array(*[F.lit(float(x)) for x in weights])
        top = _total(F.zip_with(scores, w, lambda s, x: F.coalesce(s * x, F.lit(0.0))))
        low = _total(F.zip_with(scores, w, lambda s, x: F.when(s.isNotNull(), x).otherwise(0.0)))
        return F.coalesce(F.try_divide(top, low) >= threshold, F.lit(False))
    raise ValueError(f"unknown voting strategy {strategy}")


# --- rewards ------------------------------------------------------------------------------------


def with_reward(decisions: DataFrame, table: str = "extended") -> DataFrame:
    """Reward of every decision from a fixed table (at most seven rows, hence the hint)."""
    rows = ", ".join(f"({a}, {hit}D, {miss}D)" for a, hit, miss in REWARDS[table])
    lookup = decisions.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS r(action, _attack, _normal)")
    joined = decisions.join(F.broadcast(lookup), "action", "left")
    return joined.select(*decisions.columns, F.coalesce(F.when(F.col("is_attack"), F.col("_attack")).otherwise(F.col("_normal")), F.lit(0.0)).alias("reward"))


def is_correct(action: Column, is_attack: Column) -> Column:
    """Blocking, alerting or slowing an attack is right; so is allowing or logging the rest."""
    return F.when(is_attack, action.isin(1, 6, 2, 4, 5)).otherwise(action.isin(0, 3))


def with_streaks(decisions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``correct`` and the length of the run of equal outcomes up to each decision.

    The run length is the distance to the last change, found with blocked scans, so the
    whole sequence never sits in one window.
    """
    rows = with_global_block(decisions.withColumn("correct", is_correct(F.col("action"), F.col("is_attack"))), "seq", block_rows)
    seen = previous_value(rows, [], ["seq"], F.col("correct"), "_before")
    counted = running_totals(seen, [], ["seq"], {"_no": F.lit(1)})
    change = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("correct")), F.col("_no"))
    last = running_last(counted, [], ["seq"], {"_since": change})
    return last.withColumn("streak", F.col("_no") - F.col("_since") + 1).drop("_before", "_no", "_since")


def shaped_rewards(decisions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Configurable reward: base table, x1.5 for severe attacks, and a bonus or malus once a
    streak is longer than three; plus the cumulative reward in decision order."""
    based = with_reward(with_streaks(decisions, block_rows), "configurable")
    severe = F.when(F.col("is_attack") & (F.col("threat_score") > 0.7), SEVERITY).otherwise(1.0)
    bonus = F.when(F.col("streak") > STREAK_AFTER, F.when(F.col("correct"), STREAK_RIGHT).otherwise(STREAK_WRONG)).otherwise(0.0)
    shaped = based.withColumn("reward", F.col("reward") * severe + bonus)
    return running_totals(shaped, [], ["seq"], {"total_reward": F.col("reward")})


def reward_summary(rewarded: DataFrame) -> DataFrame:
    return rewarded.agg(F.sum("reward").alias("total_rewards"), F.count(F.lit(1)).alias("episode_count"),
                        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("avg_reward"))


def policy_outcomes(decisions: DataFrame) -> DataFrame:
    """Confusion counts of a logged policy; blocking and quarantine are the positive actions."""
    blocking, attack = F.col("action").isin(1, 6), F.col("is_attack")
    return decisions.agg(
        F.count_if(attack & blocking).alias("tp"), F.count_if(~attack & ~blocking).alias("tn"),
        F.count_if(~attack & blocking).alias("fp"), F.count_if(attack & ~blocking).alias("fn"))
