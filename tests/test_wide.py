"""Wide rows run as compiled code and are rounded as ``F.round`` does."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewatch.functions.vectors import rounded
from tidewatch.plans.registry import runner


def test_wide_queries_stay_below_what_the_jvm_compiles(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    runner(lambda t: t.spark.range(1))(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_quick_rounding_is_that_of_spark(spark):
    rng = random.Random(7)
    values = [rng.uniform(-3, 3) for _ in range(20_000)] + [k / 2000 for k in range(-4001, 4001)] + [rng.uniform(-1e12, 1e12) for _ in range(2_000)]
    values += [x + d for x in (0.0005, 2.5e-9, 1.0000005, -0.1234565) for d in (-1e-12, -1e-17, 0.0, 1e-17, 1e-12)]
    values += [None, float("nan"), float("inf"), float("-inf"), -0.0, 1e300, -1e300, 5e-324, 1e6 - 5e-7]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (3, 6, 9):
        both = df.select("x", F.round("x", digits).alias("a"), rounded(F.col("x"), digits).alias("b"))
        assert both.where(~F.hex(F.col("a").cast("string")).eqNullSafe(F.hex(F.col("b").cast("string")))).collect() == []
