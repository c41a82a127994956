"""Ordered scans and exact order statistics that do not depend on one task per key.

A running value over a key is computed in two levels. Keys are cut into blocks of
consecutive rows by the quantiles of their own rows, so a (key, block) group is bounded however
hot or bursty the key is; a key of up to ``BLOCK_ROWS`` rows is one block.

1. inside each (key, block) a normal window runs,
2. one summary row per (key, block) is scanned per key, which is smaller by the block size,
3. the state before the block joins back on (key, block); the big side is already hash
   partitioned on these columns by the window, so only the summaries move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.runtime import BLOCK_ROWS

BLOCK = "_blk"
#: Mark of a block column that is 0 in every row, as no key is hot.
ONE = "one block"
#: Steps of the quantiles of a hot key, and so its most blocks.
QUANTILES = 512


def with_block(df: DataFrame, keys: list[str], ordinal: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the block of every row; ``ordinal`` is a unique number that orders rows."""
    return with_value_block(df, keys, F.col(ordinal), rows)


def with_value_block(df: DataFrame, keys: list[str], value: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the block of every row of rows ordered by a number, such as a time.

    Keys are counted with a map-side combine; the hot ones, at most ``n / rows``, get
    quantiles of their own rows from mergeable sketches. Their blocks are made of whole
    quantile steps and aim at three quarters of ``rows``; rows of equal value stay together. A
    key of more than ``QUANTILES`` blocks gets larger ones. The count is a job of its own: without a hot key, as in most tables,
    the rows are not joined with any cuts and stay where they lie. Hot keys and their cuts are broadcast: 4 KB at most for
    every ``rows`` rows of the input.
    """
    timed = df.withColumn("_t", value.cast("double"))
    own = [c.eqNullSafe(d) for c, d in ((F.col(k), F.col(f"_k_{k}")) for k in keys)]
    match = own[0]
    for c in own[1:]:
        match = match & c
    hot = timed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    if hot.isEmpty():
        return df.withColumn(BLOCK, F.lit(0).cast("bigint").alias(BLOCK, metadata={ONE: True}))
    cuts = (timed.join(F.broadcast(hot), match).groupBy(*[f"_k_{k}" for k in keys], "_n")
            .agg(F.percentile_approx("_t", steps, 20 * QUANTILES).alias("_q")))
    blocks = F.least(F.ceil(F.col("_n") / F.lit(0.75 * rows)), F.lit(QUANTILES)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), blocks - 1), lambda i: F.get("_q", F.floor(i * F.lit(QUANTILES) / blocks).cast("int") - 1))
    cuts = cuts.select(*[f"_k_{k}" for k in keys], F.when(blocks > 1, F.array_distinct(chosen)).alias("_cuts"))
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))).cast("bigint"), F.lit(0).cast("bigint"))
    return timed.join(F.broadcast(cuts), match, "left").select(*df.columns, block.alias(BLOCK))


def one_block(df: DataFrame) -> bool:
    """Whether every key of ``df`` is surely one block, so that no state has to be carried."""
    return bool(df.schema[BLOCK].metadata.get(ONE))


def with_global_block(df: DataFrame, ordinal: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of a scan over the whole table in ordinal order."""
    return df.withColumn(BLOCK, F.floor(F.col(ordinal) / F.lit(rows)).cast("bigint"))


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Value of the row before, per key and across blocks; null on the first row of a key."""
    local = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    ends = df.groupBy(*keys, BLOCK).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, BLOCK, F.lag("_end").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_car"))
    within = df.withColumn("_lag", F.lag(value).over(local))
    return within.join(carried, [*keys, BLOCK]).select(*df.columns, F.coalesce("_lag", "_car").alias(out))


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column]
) -> DataFrame:
    """Inclusive running sum of each measure per key, named by the dict keys.

    ``df`` carries the block column, which must grow with ``order`` inside a key.
    """
    local = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = df.select("*", *[F.sum(c).over(local).alias(f"_run_{n}") for n, c in measures.items()])
    totals = df.groupBy(*keys, BLOCK).agg(*[F.sum(c).alias(f"_tot_{n}") for n, c in measures.items()])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, BLOCK,
        *[F.coalesce(F.sum(f"_tot_{n}").over(before), F.lit(0)).alias(f"_car_{n}") for n in measures],
    )
    joined = scanned.join(carried, [*keys, BLOCK])
    return joined.select(
        *df.columns,
        *[(F.col(f"_run_{n}") + F.col(f"_car_{n}")).alias(n) for n in measures],
    )


def running_last(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]
) -> DataFrame:
    """Latest non-null value of each expression up to and including the row, per key."""
    local = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = df.select("*", *[F.last(c, ignorenulls=True).over(local).alias(f"_run_{n}") for n, c in values.items()])
    at = F.struct(*order)
    ends = df.groupBy(*keys, BLOCK).agg(*[
        F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_end_{n}") for n, c in values.items()])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, BLOCK, *[
        F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_car_{n}") for n in values])
    joined = scanned.join(carried, [*keys, BLOCK])
    return joined.select(*df.columns, *[F.coalesce(f"_run_{n}", f"_car_{n}").alias(n) for n in values])


def order_statistics(
    df: DataFrame, value: str, picks: dict[str, Column], group: str | None = None,
    few_groups: bool = False, buckets: int = 4096, levels: int = 2,
) -> DataFrame:
    """Exact k-th smallest values without a global sort.

    ``picks`` maps an output name to a zero-based rank expressed over ``n``, the number of
    non-null values. Equal values are counted first (map-side combined). A histogram of
    equal-width buckets tells which bucket holds each rank; the next level does the same
    between the smallest and the largest value of that bucket, so one outlier does not
    spoil the resolution. Only the distinct values of the last buckets are ranked.

    ``few_groups`` says that the groups are names from a fixed list, such as columns; the
    per-group tables then have a known size and are broadcast, as without groups.
    """
    small = F.broadcast if group is None or few_groups else (lambda t: t)
    g = F.col(group) if group else F.lit(0)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(g.alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    span = counts.groupBy("_g").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("pick"), rank.cast("bigint").alias("rank")) for name, rank in picks.items()
    ]))
    # where every pick still has to look: value range and the count below it
    search = span.select("_g", "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"), wanted.alias("w")).select(
        "_g", "_lo", "_hi", "_before", "w.*")
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    for _ in range(levels):
        inside = counts.join(small(search), "_g").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        hist = inside.groupBy("_g", "pick", bucket.alias("_b")).agg(
            F.sum("_c").alias("_bc"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.first("_before").alias("_base"), F.first("rank").alias("rank"))
        lower = Window.partitionBy("_g", "pick").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_bc").over(lower), F.lit(0)))
        search = hist.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_bc"))).select(
            "_g", "_lo", "_hi", "_before", "pick", "rank")
    upto = Window.partitionBy("_g", "pick").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counts.join(small(search), "_g").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(upto))
        .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
        .groupBy("_g").pivot("pick", list(picks)).agg(F.first("_v"))
    )
    return found.withColumnRenamed("_g", group) if group else found.drop("_g")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side (a union folded by ``max``, not a join)."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])
