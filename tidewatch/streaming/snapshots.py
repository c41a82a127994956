"""Stateful streams whose state is a table: one version per micro-batch.

The batch operators already split hot keys, so a micro-batch is processed by them, started
from the state version before and leaving the next one. A repeated micro-batch reads the
same version again and overwrites its own results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import behavior as B
from tidewatch.operators import incstats as I
from tidewatch.runtime import shared_dir
from tidewatch.sources.streams import for_each_batch


class Versions:
    """Numbered state tables below one folder."""

    def __init__(self, folder: str, name: str = "version") -> None:
        self.folder, self.name = folder, name

    def path(self, number: int) -> str:
        return f"{self.folder}/{self.name}={number}"

    def remove(self, spark) -> None:
        """Remove the whole folder."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, state: DataFrame, number: int) -> None:
        state.write.mode("overwrite").parquet(self.path(number))

    def read(self, spark, number: int) -> DataFrame:
        return spark.read.parquet(self.path(number))

    def exists(self, spark) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def forget(self, spark, number: int) -> None:
        """Remove a version that no repeated micro-batch can ask for any more."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(number))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def newest(self, spark) -> int:
        """Number of the newest version."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return max(int(s.getPath().getName().split("=", 1)[1]) for s in found)


def stream_damped(packets: DataFrame, channels: list[str] = I.CHANNELS, keep_seconds: float | None = None, folder: str | None = None) -> DataFrame:
    """Damped statistics of every packet over the micro-batches of a stream. The faded sums are
    written, once per packet and channel; the next state and the statistics are read from them. Keys not seen
    for ``keep_seconds`` of event time leave the state. With a ``folder`` of the caller's a
    later call goes on from the state that this one left."""
    spark = packets.sparkSession
    folder = folder or shared_dir(spark, "damped")
    results, versions = f"{folder}/results", Versions(f"{folder}/versions")

    def step(batch: DataFrame, number: int) -> None:
        rows = I.channel_rows(batch, channels)
        before = versions.read(spark, number - 1) if number > 0 else None
        I.damped_step(rows, I.statistic_sums(), before=before).write.mode("overwrite").parquet(path := f"{results}/batch={number}")
        after = I.state_after(spark.read.parquet(path), I.statistic_sums(), before=before)
        if keep_seconds is not None:
            after = after.where(F.col("tau") >= after.agg(F.max("tau")).scalar() - F.lit(keep_seconds))
        versions.write(after, number)
        if number > 1:
            versions.forget(spark, number - 2)

    for_each_batch(packets, "damped", step, folder)
    sums = spark.read.parquet(results)
    return I.statistics_of(sums, ["pkt_no", "ts_s", "value", "channel", "key"], len(I.RATES))


def stream_ensemble(packets: DataFrame, map_rows: int = 5_000, train_rows: int = 50_000, folder: str | None = None, **settings) -> DataFrame:
    """Anomaly scores of a packet stream: damped statistics, packet vectors and the ensemble of encoders in one micro-batch.

    ``pkt_no`` numbers the packets from 0 without gaps, in order of arrival. The state of the damped statistics, the vectors of
    the training range (at most ``map_rows + train_rows``), the phase (how many packets were seen) and the
    trained ensemble are versions below ``folder``. The micro-batch that completes the training range trains the ensemble and
    scores what it holds beyond; rows of the range come out as training rows, as in a batch run. A repeated
    micro-batch reads the versions before it and overwrites its own; a later call with the same folder goes on from them.
    Returns pkt_no, rmse, is_training, label and probability.
    """
    spark = packets.sparkSession
    folder = folder or shared_dir(spark, "ensemble")
    results, range_of = f"{folder}/results", f"{folder}/range"
    sums, phases, models = (Versions(f"{folder}/{n}") for n in ("versions", "phases", "models"))
    trained_until = map_rows + train_rows

    def step(batch: DataFrame, number: int) -> None:
        before = sums.read(spark, number - 1) if number else None
        vectors, after = I.vector_step(batch, before=before)
        sums.write(after, number)
        seen, model_at = phases.read(spark, number - 1).first() if number else (0, -1)
        if model_at < 0:
            # vectors of the range depend on no later packet
            early = I.vector_step(batch.where(F.col("pkt_no") < trained_until), before=before)[0]
            early.write.mode("overwrite").parquet(f"{range_of}/batch={number}")
        seen += batch.count()
        if model_at < 0 and seen >= trained_until:
            # versions of later batches cannot be there: a batch is repeated only while it is the newest
            known = spark.read.parquet(range_of).drop("batch")
            A.EncoderEnsemble.fit(known, "pkt_no", "vector", map_rows, train_rows, **settings).save(spark, models.path(number))
            model_at = number
        if model_at >= 0:
            # vectors are scored as they come and never written
            scored = A.EncoderEnsemble.load(spark, models.path(model_at)).score(vectors, "vector", "pkt_no", trained_until).drop("vector")
        else:
            scored = A.in_training(batch.select("pkt_no"))
        scored.select("pkt_no", "rmse", "is_training", "label", "probability").write.mode("overwrite").parquet(f"{results}/batch={number}")
        phases.write(spark.createDataFrame([(seen, model_at)], "seen long, model_at long"), number)
        for old in (sums, phases):
            if number > 1:
                old.forget(spark, number - 2)

    for_each_batch(packets, "ensemble", step, folder)
    return spark.read.parquet(results).drop("batch")


def stream_security_states(packets: DataFrame, window: int = 60, slide: int = 10, delay: int = 10, folder: str | None = None) -> DataFrame:
    """Security indicators per target over sliding windows, with exact numbers of distinct sources and ports.

    ``slide`` must divide ``window``. The state holds, for every slide interval that an open window covers, the sums of each target and
    its distinct values, so a value counts once in a window however often it is seen, and a hot target is counted by
    partial sums over its values. Intervals leave the state when the last window that covers them has
    ended ``delay`` seconds before the newest packet; packets for ended windows count in none of these. A repeated
    micro-batch overwrites its own results; a later call with the same folder goes on from the state.
    Null sources and ports are not counted. Returns the newest state of every window.
    """
    spark = packets.sparkSession
    folder = folder or shared_dir(spark, "security")
    results = f"{folder}/results"
    sums, values, clocks = (Versions(f"{folder}/{n}") for n in ("sums", "values", "clocks"))
    starts = F.explode(F.sequence(F.col("slot") - (window - slide), F.col("slot"), F.lit(slide).cast("bigint")))
    merged = [F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.sum("syn").alias("syn"), F.min("first").alias("first"), F.max("last").alias("last")]

    def step(batch: DataFrame, number: int) -> None:
        slot = (F.floor(F.col("ts_s") / slide) * slide).cast("bigint")
        rows = batch.select("dst_ip", slot.alias("slot"), "src_ip", "dst_port", "packet_size", "tcp_flags", "ts_s")
        newest = rows.agg(F.max("ts_s")).first()[0]
        before = clocks.read(spark, number - 1).first()["newest"] if number else None
        closed = before - delay if before is not None else float("-inf")
        rows = rows.where(F.col("slot") + window > closed)  # what no open window covers
        fresh = rows.groupBy("dst_ip", "slot").agg(
            F.count(F.lit(1)).alias("packets"), F.sum(F.col("packet_size").cast("double")).alias("bytes"),
            F.count_if(F.col("tcp_flags").bitwiseAND(F.lit(2)) != 0).alias("syn"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"))
        pairs = rows.select("dst_ip", "slot", F.inline(F.array(F.struct(F.lit("src").alias("kind"), F.col("src_ip").alias("value")),
                                                               F.struct(F.lit("port").alias("kind"), F.col("dst_port").cast("string").alias("value")))))
        pairs = pairs.where("value IS NOT NULL").distinct()
        touched = rows.select("dst_ip", "slot").distinct().select("dst_ip", starts.alias("window_s")).where(F.col("window_s") + window > closed).distinct()
        now = max(x for x in (newest, before, float("-inf")) if x is not None)
        if number:
            fresh = sums.read(spark, number - 1).unionByName(fresh).groupBy("dst_ip", "slot").agg(*merged)
            pairs = values.read(spark, number - 1).unionByName(pairs).distinct()
        live = F.col("slot") + window > now - delay
        # results need all intervals of the windows touched now, the next state only those of windows still open then
        fresh.write.mode("overwrite").parquet(f"{folder}/all/sums-{number}")
        pairs.write.mode("overwrite").parquet(f"{folder}/all/values-{number}")
        fresh, pairs = spark.read.parquet(f"{folder}/all/sums-{number}"), spark.read.parquet(f"{folder}/all/values-{number}")
        totals = fresh.select("*", starts.alias("window_s")).join(touched, ["dst_ip", "window_s"]).groupBy("dst_ip", "window_s").agg(*merged)
        seen = pairs.select("*", starts.alias("window_s")).join(touched, ["dst_ip", "window_s"]).select("dst_ip", "window_s", "kind", "value").distinct()
        distinct = seen.groupBy("dst_ip", "window_s").agg(F.count_if(F.col("kind") == "src").alias("unique_src_ips"), F.count_if(F.col("kind") == "port").alias("unique_dst_ports"))
        # a null target is a target like any other
        same = totals["dst_ip"].eqNullSafe(distinct["dst_ip"]) & (totals["window_s"] == distinct["window_s"])
        rated = totals.join(distinct, same, "left").select(
            totals["window_s"], totals["dst_ip"], (F.col("packets") / float(window)).alias("packet_rate"), (F.col("bytes") / float(window)).alias("byte_rate"),
            F.coalesce("unique_src_ips", F.lit(0)).alias("unique_src_ips"), F.coalesce("unique_dst_ports", F.lit(0)).alias("unique_dst_ports"),
            (F.col("syn") / F.col("packets")).alias("syn_ratio"), (F.col("bytes") / F.col("packets")).alias("avg_packet_size"), (F.col("last") - F.col("first")).alias("flow_duration"))
        rated.write.mode("overwrite").parquet(f"{results}/batch={number}")
        sums.write(fresh.where(live), number)
        values.write(pairs.where(live), number)
        clocks.write(spark.createDataFrame([(float(now),)], "newest double"), number)
        Versions(f"{folder}/all/sums-{number}").remove(spark)
        Versions(f"{folder}/all/values-{number}").remove(spark)
        for old in (sums, values, clocks):
            if number > 1:
                old.forget(spark, number - 2)

    for_each_batch(packets, "security", step, folder)
    rows = spark.read.parquet(results)
    names = [c for c in rows.columns if c not in ("window_s", "dst_ip", "batch")]
    return rows.groupBy("window_s", "dst_ip").agg(F.max_by(F.struct(*names), "batch").alias("v")).select("window_s", "dst_ip", "v.*")


def initial_reputation(lists: DataFrame) -> DataFrame:
    """Reputation table from the address lists."""
    none = F.array().cast("array<string>")
    return lists.select(
        "ip", B.list_score(F.col("list_name")).alias("score"),
        F.when(F.col("list_name") == "blacklist", F.array(F.lit("unknown"))).otherwise(none).alias("categories"),
        F.lit(0).cast("bigint").alias("reports"), F.col("list_name").alias("source"))


def with_scores(rows: DataFrame, reputation: DataFrame) -> DataFrame:
    for side in ("src", "dst"):
        found = reputation.select(F.col("ip").alias(f"{side}_ip"), F.col("score").alias("_s"))
        rows = rows.join(found, f"{side}_ip", "left").withColumn(f"{side}_reputation", F.coalesce("_s", F.lit(0.5))).drop("_s")
    return rows


def lower(reputation: DataFrame, reports: DataFrame) -> DataFrame:
    """The reputation table after more reports."""
    sums = reports.groupBy("ip").agg(F.sum("confidence").alias("_c"), F.collect_set("category").alias("_k"), F.count(F.lit(1)).alias("_n"))
    none = F.array().cast("array<string>")

    def had(c: str, default: Column) -> Column:
        return F.coalesce(F.col(c), default)

    return reputation.join(sums, "ip", "full_outer").select(
        "ip", F.greatest(F.lit(0.0), had("score", F.lit(0.5)) - 0.2 * had("_c", F.lit(0.0))).alias("score"),
        F.array_sort(F.array_union(had("categories", none), had("_k", none))).alias("categories"),
        (had("reports", F.lit(0)) + had("_n", F.lit(0))).alias("reports"), had("source", F.lit("unknown")).alias("source"))


def stream_feedback(scored: DataFrame, lists: DataFrame, folder: str | None = None) -> DataFrame:
    """Final reputation after strong verdicts have lowered their sources, batch by batch: a
    micro-batch is judged by the reputation that the batches before it left. With a ``folder``
    of the caller's a later call goes on from there and does not read ``lists`` again."""
    spark = scored.sparkSession
    folder = folder or shared_dir(spark, "reputation")
    versions = Versions(f"{folder}/versions")
    if not versions.exists(spark):
        versions.write(initial_reputation(lists), -1)

    def step(batch: DataFrame, number: int) -> None:
        now = versions.read(spark, number - 1)
        judged = B.verdicts(with_scores(batch, now))
        versions.write(lower(now, B.reports_from(judged)), number)
        if number > 0:
            versions.forget(spark, number - 2)

    for_each_batch(scored, "feedback", step, folder)
    return versions.read(spark, versions.newest(spark))
