"""Exact, repeatable splits, samples and class balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 20


def mark_fraction(
    df: DataFrame, ids: list[str], fraction: float | None = None, rows: int | Column | None = None,
    seed: int = 42, by: str | None = None, out: str = "picked", few_classes: bool = False,
) -> DataFrame:
    """Add a flag that is true for exactly ``rows`` or ``round(fraction * n)`` rows.

    ``rows`` may be a column of ``n``, the number of rows of the class.
    Rows are ranked by a hash of their ids. A histogram over the leading hash bits names the
    bucket of the cut (one of 2**20), only that bucket is ranked, and the result is a
    comparison per row. Without ``by`` the one row of the cut reaches the driver and the table
    is neither sorted nor shuffled. With ``by`` the share is taken inside every class and the
    cuts, one row per class, stay a frame that is joined; there may be any number of classes.
    ``few_classes`` says that they are the classes of a model: their cuts are broadcast, and no task gets all rows of a class.
    """
    g = F.col(by) if by else F.lit(0)
    h = F.xxhash64(*[F.col(c) for c in ids], F.lit(seed))
    keyed = df.select(g.alias("_g"), h.alias("_h"), *ids).withColumn("_hb", F.shiftrightunsigned("_h", 64 - BITS))
    # leading bits in signed order, so buckets follow the order of the hash itself
    keyed = keyed.withColumn("_hb", F.pmod(F.col("_hb") + (1 << (BITS - 1)), F.lit(1 << BITS)))
    per_class = Window.partitionBy("_g")
    running = per_class.orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)
    want = (rows if isinstance(rows, Column) else F.lit(rows)).cast("bigint") if rows is not None else F.round(F.col("n") * F.lit(fraction)).cast("bigint")
    edges = (
        keyed.groupBy("_g", "_hb").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("upto", F.sum("c").over(running)).withColumn("n", F.sum("c").over(per_class))
        .withColumn("want", F.least(want, F.col("n")))
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
        .select(F.col("_g").alias("_eg"), F.col("_hb").alias("_eb"), (F.col("want") - F.col("upto") + F.col("c")).alias("_need"))
    )
    rank = F.row_number().over(per_class.orderBy("_h", *ids))
    last = (
        keyed.join(edges, F.col("_g").eqNullSafe(F.col("_eg")) & (F.col("_hb") == F.col("_eb")))
        .select("_g", "_h", *ids, "_need").withColumn("_r", rank).where("_r = _need")
    )
    mine = F.struct(h.alias("_h"), *ids)
    if not by:
        edge = last.first()
        if edge is None:
            return df.withColumn(out, F.lit(False))
        limit = F.struct(*[F.lit(edge[c]).cast(last.schema[c].dataType).alias(c) for c in ("_h", *ids)])
        return df.withColumn(out, mine <= limit)
    cuts = last.select(F.col("_g").alias("_cg"), F.struct("_h", *ids).alias("_cut"))
    joined = df.join(F.broadcast(cuts) if few_classes else cuts, F.col(by).eqNullSafe(F.col("_cg")), "left")
    return joined.select(*df.columns, F.coalesce(mine <= F.col("_cut"), F.lit(False)).alias(out))


def split(df: DataFrame, ids: list[str], test_size: float = 0.2, seed: int = 42,
          by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; the test part has exactly ``round(n * test_size)`` rows."""
    marked = mark_fraction(df, ids, fraction=test_size, seed=seed, by=by, out="_test")
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


def sample(df: DataFrame, ids: list[str], rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows (all of them when there are fewer), the same for every run."""
    return mark_fraction(df, ids, rows=rows, seed=seed).where("picked").drop("picked")


def folds(df: DataFrame, ids: list[str], k: int, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1 from a hash of the ids; needs no shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*[F.col(c) for c in ids], F.lit(seed)), F.lit(k)).cast("int"))


STRATEGIES = ["none", "undersample", "oversample", "smote"]


def balance(df: DataFrame, label: str, ids: list[str], strategy: str = "none", seed: int = 42,
            features: list[str] | None = None, neighbours: int = 5) -> DataFrame:
    """Bring every class to the size of the smallest or of the largest class.

    There may be any number of classes: their sizes stay a frame, only the goal reaches the driver.
    ``smote`` alone searches neighbours class by class, and so reads the sizes on the driver.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy}")
    if strategy == "none":
        return df
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    goal = sizes.agg(F.min("_n") if strategy == "undersample" else F.max("_n")).first()[0]
    if goal is None:
        return df
    if strategy == "undersample":
        return mark_fraction(df, ids, rows=goal, seed=seed, by=label).where("picked").drop("picked")
    marked = mark_fraction(df, ids, rows=F.pmod(F.lit(goal) - F.col("n"), F.col("n")), seed=seed, by=label, out="_more")
    named = sizes.withColumnRenamed(label, "_class")
    counted = marked.join(named, F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")
    times = F.floor((F.lit(goal) - F.col("_n")) / F.col("_n")).cast("int") + F.col("_more").cast("int")
    if strategy == "oversample":
        return counted.withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).select(*df.columns)
    lacking = counted.withColumn("_times", times).drop("_more", "_n")
    out = df
    for (value,) in sizes.where(F.col("_n") < goal).select(label).collect():
        made = _interpolated(lacking.where(F.col(label).eqNullSafe(F.lit(value))), ids, features, neighbours, seed)
        out = out.unionByName(made, allowMissingColumns=True)
    return out


def _interpolated(rows: DataFrame, ids: list[str], features: list[str], k: int, seed: int) -> DataFrame:
    """Synthetic rows between a row and one of its k nearest rows of the same class.

    Only rows that get copies ask, and equal ones ask once. Of equal rows the k + 1 of smallest id give: the k nearest of any
    row, nearer ones first and ties by id, hold no others.
    """
    from tidewatch.operators.similarity import nearest
    from tidewatch.runtime import dealt

    keyed = dealt(rows.withColumn("_id", F.col(ids[0]) if len(ids) == 1 else F.to_json(F.struct(*ids)))
                  .withColumn("_vec", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])), "smote", "_id")
    of_equals = Window.partitionBy("_vec").orderBy("_id")
    givers = dealt(keyed.select("_id", "_vec").withColumn("_r", F.row_number().over(of_equals)).where(F.col("_r") <= k + 1).drop("_r"), "givers")
    wanted = keyed.where("_times > 0")
    asking = dealt(wanted.groupBy("_vec").agg(F.min("_id").alias("_asks")), "askers")
    near = nearest(asking.select(F.col("_asks").alias("_id"), "_vec"), givers, k + 1, "_id", "_vec", metric="euclidean")
    lists = near.groupBy(F.col("query_id").alias("_asks")).agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("_near"))  # at most k + 1
    wanted = wanted.join(asking.join(lists, "_asks").select("_vec", F.col("_near.item_id").alias("_near")), "_vec", "left")
    wanted = wanted.withColumn("_near", F.slice(F.filter("_near", lambda x: x != F.col("_id")), 1, k))
    chosen = wanted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    # a class of up to k rows has fewer neighbours; a lone row is its own
    have = F.nullif(F.size("_near"), F.lit(0)).cast("bigint")
    pick = F.pmod(F.xxhash64("_id", "_copy", F.lit(seed)), have).cast("int")
    gap = F.pmod(F.xxhash64("_copy", "_id", F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = chosen.withColumn("_gap", gap).withColumn("_other", F.coalesce(F.get("_near", pick), "_id")).drop("_vec", "_near")
    joined = chosen.join(keyed.select(F.col("_id").alias("_other"), F.col("_vec").alias("_to")), "_other")
    made = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + F.col("_gap") * (F.get("_to", F.lit(i)) - F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).alias(c)
            for i, c in enumerate(features)]
    rest = [c for c in rows.columns if c not in features and c != "_times"]
    return joined.select(*rest, *made)
