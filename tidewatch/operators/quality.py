"""Schema checks, column profiles, imputation and drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.scans import BLOCK, order_statistics, running_totals, with_value_block
from tidewatch.runtime import materialize, spread
from tidewatch.schemas import missing_and_extra


def schema_difference(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per missing or extra column."""
    missing, extra = missing_and_extra(df.columns, required)
    rows = [(c, "missing") for c in missing] + [(c, "extra") for c in extra]
    return df.sparkSession.createDataFrame(rows, "feature string, status string")


def has_column_count(df: DataFrame, expected: int) -> bool:
    return len(df.columns) == expected


def numeric_columns_ok(df: DataFrame, required: list[str]) -> bool:
    """All required columns are present and numeric."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return all(isinstance(types.get(c), T.NumericType) for c in required)


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def validation_report(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per present or missing column: status, nulls, type and value range.

    All columns are profiled in one scan with one partial aggregate per task.
    """
    missing, extra = missing_and_extra(df.columns, required)
    numeric = set(numeric_names(df))
    profile = []
    for c in df.columns:
        nulls = F.count_if(F.col(c).isNull())
        low = F.min(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")
        high = F.max(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")
        profile.append(F.struct(
            F.lit(c).alias("feature"), F.lit("extra" if c in extra else "present").alias("status"),
            F.lit(c in numeric).alias("is_numeric"), nulls.alias("null_count"),
            low.alias("min_value"), high.alias("max_value")))
    gone = [F.struct(
        F.lit(c).alias("feature"), F.lit("missing").alias("status"), F.lit(False).alias("is_numeric"),
        F.lit(0).cast("bigint").alias("null_count"), F.lit(None).cast("double").alias("min_value"),
        F.lit(None).cast("double").alias("max_value")) for c in missing]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.array(*profile).alias("p"))
    rows = F.concat("p", F.array(*gone)) if gone else F.col("p")
    percent = F.coalesce(F.try_divide(F.col("r.null_count") * F.lit(100.0), F.col("n")), F.lit(0.0))
    return one.select("n", F.explode(rows).alias("r")).select(
        "r.feature", "r.status", "r.is_numeric", "r.null_count",
        F.round(percent, 2).alias("null_percent"), (percent > 10).alias("many_nulls"),
        "r.min_value", "r.max_value",
        F.coalesce((F.col("r.min_value") < -10) | (F.col("r.max_value") > 10), F.lit(False)).alias("out_of_range"),
    )


def is_valid(report: DataFrame) -> DataFrame:
    """One row: valid when nothing is missing and every present column is numeric."""
    return report.agg(
        (F.count_if(F.col("status") == "missing") == 0).alias("all_present"),
        (F.count_if((F.col("status") != "missing") & ~F.col("is_numeric")) == 0).alias("all_numeric"),
    ).withColumn("is_valid", F.col("all_present") & F.col("all_numeric"))


def imputation_advice(df: DataFrame) -> DataFrame:
    """Share of missing cells of the whole table and the strategies to use, by priority."""
    cells = F.count(F.lit(1)) * len(df.columns)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    percent = F.coalesce(F.try_divide(nulls * F.lit(100.0), cells), F.lit(0.0))
    p = F.col("p")
    advice = (
        F.when(p == 0, F.array(F.lit("none"))).when(p < 5, F.array(F.lit("mean")))
        .when(p < 15, F.array(F.lit("knn"), F.lit("median")))
        .otherwise(F.array(F.lit("constant"), F.lit("most_frequent")))
    )
    return df.agg(percent.alias("p")).select(
        F.round(p, 2).alias("missing_percentage"), F.posexplode(advice).alias("pos", "strategy")
    ).select("missing_percentage", "strategy", (F.col("pos") + 1).alias("priority"))


def feature_catalogue(df: DataFrame, required: list[str], labels: tuple = (-1, 0, 1)) -> DataFrame:
    """Required features in order with the share of usual values seen in the table."""
    usual = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit("integer").alias("type"),
                      F.count_if(F.col(c).isin(*labels)).alias("usual_values"), F.count(F.col(c)).alias("filled"))
             for i, c in enumerate(required)]
    return df.agg(F.array(*usual).alias("a")).select(F.explode("a").alias("e")).select("e.*")


# --- imputation -----------------------------------------------------------------------


def add_missing_columns(df: DataFrame, required: list[str], value: int = 0) -> tuple[DataFrame, list[str]]:
    missing, _ = missing_and_extra(df.columns, required)
    return df.withColumns({c: F.lit(value) for c in missing}) if missing else df, missing


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return spread(df).select(F.explode(cells).alias("e")).select("e.*")


def fill_values(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """One fill value per column: mean, exact median or most frequent (smallest on ties)."""
    if strategy == "mean":
        one = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("fill")) for c in columns]).alias("a"))
        return one.select(F.explode("a").alias("e")).select("e.*")
    if strategy == "median":
        n = F.col("n")
        mid = order_statistics(_long(df, columns), "value", {
            "below": F.floor((n - 1) / 2), "above": F.floor(n / 2)}, group="feature", few_groups=True)
        return mid.select("feature", ((F.col("below") + F.col("above")) / 2).alias("fill"))
    if strategy == "most_frequent":
        counts = _long(df, columns).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
        return counts.groupBy("feature").agg(F.max_by("value", F.struct("c", -F.col("value"))).alias("fill"))
    raise ValueError(f"unknown strategy {strategy}")


def impute(df: DataFrame, columns: list[str], strategy: str = "constant", fill_value: float = 0) -> DataFrame:
    """Replace nulls. The fitted values (one per column) pass through the driver."""
    if strategy == "constant":
        return df.fillna(fill_value, subset=columns)
    fills = {r["feature"]: r["fill"] for r in fill_values(df, columns, strategy).collect()}
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(fills.get(c, float(fill_value))).cast("double")) for c in columns})


def impute_report(df: DataFrame, required: list[str], strategy: str = "constant",
                  fill_value: int = 0, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Add missing columns, impute, and select the required ones; plus a report row per
    column that was added or had nulls."""
    full, added = add_missing_columns(df, required, fill_value)
    if strategy == "knn":
        from tidewatch.operators.similarity import knn_impute
        filled = knn_impute(full, required, k=5)
    else:
        filled = impute(full, required, strategy, fill_value)
    counts = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in added).alias("added"),
                                F.count_if(F.col(c).isNull()).alias("missing_count"),
                                F.lit(strategy).alias("strategy")) for c in required])
    report = full.agg(counts.alias("a")).select(F.explode("a").alias("e")).select("e.*")
    return filled.select(*keep, *required), report.where("added OR missing_count > 0")


# --- drift ----------------------------------------------------------------------------


def ecdf_gap(base: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Largest distance between the two empirical distribution functions, per column.

    Equal values are counted first, so rows shuffle as distinct (column, value) pairs. The
    running counts are blocked by the magnitude of the value.
    """
    both = _long(base, columns).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(
        _long(current, columns).withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    # grows with the value: the magnitude, and inside a crowded magnitude equal shares of it
    magnitude = F.floor(F.signum("value") * F.log2(1 + F.abs("value")) * 16).cast("bigint")
    counts = (
        both.where("value IS NOT NULL").groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .withColumn("_mag", magnitude)
    )
    counts = materialize(counts, "counts")  # read by the blocks, the running counts and the sizes
    counts = with_value_block(counts, ["feature", "_mag"], F.col("value")).withColumn(BLOCK, F.struct("_mag", BLOCK)).drop("_mag")
    run = running_totals(counts, ["feature"], ["value"], {"ca": F.col("a"), "cb": F.col("b")})
    sizes = counts.groupBy("feature").agg(F.sum("a").alias("n_base"), F.sum("b").alias("n_current"))
    gap = F.abs(F.try_divide(F.col("ca"), F.col("n_base")) - F.try_divide(F.col("cb"), F.col("n_current")))
    return run.join(sizes, "feature").groupBy("feature").agg(
        F.max(gap).alias("gap"), F.first("n_base").alias("n_base"), F.first("n_current").alias("n_current"))


#: Rows of the larger sample up to which the p-value can be exact.
EXACT_ROWS = 10_000


def exact_gap_p(gap: float, n: int, m: int) -> float:
    """Probability that two samples of one continuous distribution, of n and m values, lie ``gap`` or more apart.

    The values in order are a path from (0, 0) to (n, m), all paths alike likely. Paths that stay nearer than the gap to the diagonal
    are counted row by row: those to a point come from the left or from below, so a row is the running sum of
    the one before inside the band. Rows are scaled, as the counts outgrow any number.
    """
    if n == 0 or m == 0:
        return math.nan
    apart = round(gap * n * m)  # |i * m - j * n| takes whole values
    if apart <= 0:
        return 1.0
    if n > m:
        n, m = m, n
    row, scale = np.zeros(m + 1), 0.0
    row[:min(m, (apart - 1) // n) + 1] = 1.0
    for i in range(1, n + 1):
        low, high = max(0, -((apart - 1 - i * m) // n)), min(m, (apart - 1 + i * m) // n)
        inside = np.zeros(m + 1)
        if low <= high:
            inside[low:high + 1] = np.cumsum(row[low:high + 1])
        top = inside.max()
        if top == 0.0:
            return 1.0
        row, scale = inside / top, scale + math.log(top)
    if row[m] == 0.0:
        return 1.0
    every = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, -math.expm1(scale + math.log(row[m]) - every)))


def drift_report(base: DataFrame, current: DataFrame, columns: list[str], alpha: float = 0.05, exact_rows: int = 0) -> DataFrame:
    """Two-sample test per column; drift when p <= alpha.

    The p-value is the asymptotic one, and the exact one for columns whose larger sample has at most ``exact_rows`` values
    (``EXACT_ROWS`` is a sensible bound; the exact one takes time in proportion to the product of both sizes, one column a row).
    """
    gaps = ecdf_gap(base, current, columns)
    n, m = F.col("n_base"), F.col("n_current")
    lam = F.sqrt(n * m / (n + m)) * F.col("gap")
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * tail)))
    if exact_rows:
        small = (F.greatest(n, m) <= exact_rows) & F.col("gap").isNotNull()

        @F.pandas_udf("double")
        def exact_p(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
            return pd.Series([exact_gap_p(g, int(a), int(b)) for g, a, b in zip(gap, n, m)], dtype="float64")

        # samples that are too large count as empty ones, which takes no time
        p = F.when(small, exact_p(F.when(small, F.col("gap")).otherwise(0.0), F.when(small, n).otherwise(0), F.when(small, m).otherwise(0))).otherwise(p)
    return gaps.withColumn("p_value", p).withColumn("same_distribution", F.col("p_value") > alpha)


def drift_verdict(report: DataFrame) -> DataFrame:
    return report.agg(
        F.every("same_distribution").alias("no_drift"),
        F.count_if(~F.col("same_distribution")).alias("drifted_columns"))


def check_drift(report: DataFrame, policy: str = "warn") -> bool:
    """Whether nothing drifted; with ``policy='fail'`` drift raises."""
    ok = bool(drift_verdict(report).first()["no_drift"])
    if not ok and policy == "fail":
        raise ValueError("the two samples differ in at least one column")
    return ok
