"""Flow assembly and fixed-size flow samples from packets in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.flow import closes_flow, flow_key, has_flag, swapped
from tidewatch.operators.scans import BLOCK, running_last, with_block
from tidewatch.runtime import BLOCK_ROWS

KEY = "flow_key"


def keyed(packets: DataFrame) -> DataFrame:
    return packets.withColumn(KEY, flow_key())


def assemble(packets: DataFrame, idle: float = 60.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the flows of every key: a flow ends after ``idle`` seconds without a packet
    or with a FIN/RST packet. Adds ``flow_seq`` (from 1) and ``starts``."""
    rows = with_block(keyed(packets), [KEY], "pkt_no", block_rows)
    here = F.struct("ts_s", "tcp_flags")

    def breaks(before: Column) -> Column:
        return F.coalesce((F.col("ts_s") - before["ts_s"] > idle) | closes_flow(before["tcp_flags"]), F.lit(True)).cast("int")

    local = Window.partitionBy(KEY, BLOCK).orderBy("pkt_no")
    prev = F.lag(here).over(local)
    # whether the first packet of a block starts a flow depends on the block before
    inner = rows.withColumn("_first", F.row_number().over(local) == 1).withColumn(
        "_start", F.when(F.col("_first"), 0).otherwise(breaks(prev))).withColumn(
        "_seq", F.sum("_start").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = inner.groupBy(KEY, BLOCK).agg(
        F.min_by(here, "pkt_no").alias("_head"), F.max_by(here, "pkt_no").alias("_tail"), F.sum("_start").alias("_n"))
    by_key = Window.partitionBy(KEY).orderBy(BLOCK)
    opened = F.coalesce((F.col("_head.ts_s") - F.col("_prev.ts_s") > idle) | closes_flow(F.col("_prev.tcp_flags")), F.lit(True)).cast("int")
    carried = blocks.withColumn("_prev", F.lag("_tail").over(by_key)).withColumn("_open", opened).select(
        KEY, BLOCK, "_open", F.coalesce(F.sum(F.col("_n") + F.col("_open")).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return inner.join(carried, [KEY, BLOCK]).select(
        *rows.columns, F.when(F.col("_first"), F.col("_open")).otherwise(F.col("_start")).alias("starts"),
        (F.col("_base") + F.col("_open") + F.col("_seq")).alias("flow_seq"))


def with_direction(assembled: DataFrame) -> DataFrame:
    """Add the opener of the packet's flow and whether the packet runs in its direction."""
    opened = running_last(assembled, [KEY], ["pkt_no"], {"opener_ip": F.when(F.col("starts") == 1, F.col("src_ip"))})
    return opened.withColumn("is_forward", F.col("src_ip") == F.col("opener_ip"))


def flow_table(packets: DataFrame, idle: float = 60.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per finished flow: endpoints, volumes both ways, rates and TCP flag counts.

    The direction depends on who opened the flow, which only the aggregate knows. Volumes
    are therefore summed per endpoint and assigned afterwards, so the aggregation stays a
    plain one with a map-side combine even when one flow holds most packets.
    """
    rows = assemble(packets, idle, block_rows)
    low_ip = F.when(swapped(), F.col("dst_ip")).otherwise(F.col("src_ip"))
    from_low = F.col("src_ip") == F.col("_low_ip")
    total_bytes, total_packets = F.sum("packet_size"), F.count(F.lit(1))
    opener = F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port", "protocol"), "pkt_no")
    grouped = rows.withColumn("_low_ip", low_ip).groupBy(KEY, "flow_seq").agg(
        opener.alias("o"), F.first("_low_ip").alias("_low_ip"),
        F.min_by("ts_s", "pkt_no").alias("start_time"), F.max_by("ts_s", "pkt_no").alias("end_time"),
        total_bytes.alias("_bytes"), total_packets.alias("_packets"),
        F.coalesce(F.sum(F.when(from_low, F.col("packet_size"))), F.lit(0)).alias("_low_bytes"),
        F.count_if(from_low).alias("_low_packets"),
        *[F.count_if(has_flag(F.col("tcp_flags"), n)).alias(f"{n}_count") for n in ("syn", "ack", "fin", "rst", "psh")],
    )
    low_opened = F.col("o.src_ip") == F.col("_low_ip")

    def sent(low: str, total: str) -> Column:
        return F.when(low_opened, F.col(low)).otherwise(F.col(total) - F.col(low))

    out = grouped.select(
        KEY, "flow_seq", "o.src_ip", "o.dst_ip", "o.src_port", "o.dst_port", "o.protocol", "start_time", "end_time",
        (F.col("end_time") - F.col("start_time")).alias("duration"),
        sent("_low_bytes", "_bytes").alias("bytes_sent"), sent("_low_packets", "_packets").alias("packets_sent"),
        "_bytes", "_packets", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count",
    )
    return finish(out)


def finish(flows: DataFrame) -> DataFrame:
    """Totals and rates; rates are 0 for flows without duration."""
    def rate(total: str) -> Column:
        return F.when(F.col("duration") > 0, F.col(total) / F.col("duration")).otherwise(0.0)

    return flows.select(
        "*",
        (F.col("_bytes") - F.col("bytes_sent")).alias("bytes_recv"),
        (F.col("_packets") - F.col("packets_sent")).alias("packets_recv"),
        F.coalesce(F.try_divide(F.col("_bytes"), F.col("_packets")), F.lit(0.0)).alias("avg_packet_size"),
        rate("_bytes").alias("bytes_per_second"), rate("_packets").alias("packets_per_second"),
    ).drop("_bytes", "_packets")


# --- fixed-size samples -----------------------------------------------------------------


def walk(ts: np.ndarray, size: int, span: float, held: int, start: float) -> tuple[np.ndarray, int, float]:
    """Sample ordinal of every packet, given ``held`` packets of an open sample from ``start``."""
    n, i, sample = len(ts), 0, 0
    out = np.empty(n, dtype=np.int64)
    while i < n:
        if held == 0:
            start = ts[i]
        full = i + size - held
        late = np.flatnonzero(ts[i:full] - start >= span)
        stop = i + int(late[0]) + 1 if len(late) else full
        if stop > n:
            out[i:] = sample
            return out, held + n - i, start
        out[i:stop] = sample
        sample, held, i = sample + 1, 0, stop
    return out, 0, start


def _entry_states(rows: DataFrame, size: int, span: float) -> DataFrame:
    """Open sample at the start of every block of the keys that have several blocks.

    An open sample holds at most ``size - 1`` packets, all at the end of what came before,
    so a block can be entered in ``size`` ways. Every block maps each way in to its way
    out; the maps are then chained per key over one row per block.
    """
    at_end = Window.partitionBy(KEY, BLOCK).orderBy(F.desc("pkt_no"))
    ends = rows.select(KEY, BLOCK, "pkt_no", "ts_s", F.row_number().over(at_end).alias("r")).where(F.col("r") < size)
    recent = Window.partitionBy(KEY).orderBy("pkt_no").rowsBetween(-(size - 2), 0)
    tails = ends.select(KEY, BLOCK, "pkt_no", F.collect_list("ts_s").over(recent).alias("t")).groupBy(KEY, BLOCK).agg(
        F.max_by("t", "pkt_no").alias("t"))
    by_key = Window.partitionBy(KEY).orderBy(BLOCK)
    entries = tails.select(
        KEY, BLOCK, F.lag("t").over(by_key).alias("lead_in"),
        F.count(F.lit(1)).over(Window.partitionBy(KEY)).alias("blocks"),
    ).where("blocks > 1")

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pkt_no")
        lead = pdf["lead_in"].iloc[0]
        lead = [] if lead is None else list(lead)
        ts = pdf["ts_s"].to_numpy()
        held, closed = [], []
        for k in range(len(lead) + 1):
            numbers, left, _ = walk(ts, size, span, k, lead[-k] if k else 0.0)
            done = int(numbers[-1]) + (0 if left else 1)
            held.append(left)
            closed.append(done)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], BLOCK: [pdf[BLOCK].iloc[0]], "lead_in": [lead],
                             "held": [held], "closed": [closed]})

    maps = rows.join(entries.drop("blocks"), [KEY, BLOCK]).select(KEY, BLOCK, "pkt_no", "ts_s", "lead_in").groupBy(
        KEY, BLOCK).applyInPandas(ways, f"{KEY} string, {BLOCK} bigint, lead_in array<double>, held array<int>, closed array<bigint>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        held, first, rows_out = 0, 0, []
        for r in pdf.itertuples(index=False):
            _, block, lead, exits, closed = r
            rows_out.append((r[0], block, held, float(lead[-held]) if held else 0.0, first))
            first += int(closed[held])
            held = int(exits[held])
        return pd.DataFrame(rows_out, columns=[KEY, BLOCK, "held", "start", "first_sample"])

    return maps.groupBy(KEY).applyInPandas(
        chain, f"{KEY} string, {BLOCK} bigint, held int, start double, first_sample bigint")


def assign_samples(packets: DataFrame, size: int = 10, span: float = 10.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``sample_no``: consecutive packets of a flow key, closed by the ``size``-th packet
    or by the first packet ``span`` seconds or more after the sample started."""
    rows = with_block(keyed(packets), [KEY], "pkt_no", block_rows)
    states = _entry_states(rows, size, span)
    entered = (
        rows.join(states, [KEY, BLOCK], "left").na.fill({"held": 0, "start": 0.0, "first_sample": 0})
        .repartition(KEY, BLOCK).sortWithinPartitions(KEY, BLOCK, "pkt_no")
    )
    names = [*rows.columns, "sample_no"]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, start, sample = None, 0, 0.0, 0
        for pdf in batches:
            keys, blocks, ts = pdf[KEY].to_numpy(), pdf[BLOCK].to_numpy(), pdf["ts_s"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            edges = [0, *cuts.tolist(), len(pdf)]
            out = np.empty(len(pdf), dtype=np.int64)
            for a, b in zip(edges[:-1], edges[1:]):
                if (keys[a], blocks[a]) != group:
                    group = (keys[a], blocks[a])
                    held, start, sample = int(pdf["held"].iat[a]), float(pdf["start"].iat[a]), int(pdf["first_sample"].iat[a])
                numbers, held, start = walk(ts[a:b], size, span, held, start)
                out[a:b] = numbers + sample
                sample += int(numbers[-1]) + (0 if held else 1)
            pdf["sample_no"] = out
            yield pdf[names]

    schema = entered.select(*rows.columns).schema.add("sample_no", T.LongType())
    return entered.mapInPandas(number, schema)


class SampleNumbers:
    """Table function over packets partitioned by flow key and block and ordered by arrival:
    (pkt_no, ts_s, held, start, first_sample) in, (pkt_no, sample_no) out. Keeps two numbers."""

    def __init__(self):
        self.held, self.start, self.sample, self.size, self.span = -1, 0.0, 0, 0, 0.0

    def eval(self, row, size, span):
        if self.held < 0:
            self.held, self.start, self.sample = row["held"], row["start"], row["first_sample"]
        if self.held == 0:
            self.start = row["ts_s"]
        self.held += 1
        number = self.sample
        if self.held >= size or row["ts_s"] - self.start >= span:
            self.held, self.sample = 0, self.sample + 1
        yield row["pkt_no"], number


def register_table_functions(spark) -> None:
    """Make ``sample_numbers`` available to SQL."""
    spark.udtf.register("sample_numbers", F.udtf(SampleNumbers, returnType="pkt_no bigint, sample_no bigint"))


def sample_numbers_by_function(packets: DataFrame, size: int = 10, span: float = 10.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``assign_samples`` through the table function: pkt_no and sample_no."""
    rows = with_block(keyed(packets), [KEY], "pkt_no", block_rows)
    states = _entry_states(rows, size, span)
    entered = rows.join(states, [KEY, BLOCK], "left").na.fill({"held": 0, "start": 0.0, "first_sample": 0})
    register_table_functions(packets.sparkSession)
    return packets.sparkSession.sql(
        f"SELECT pkt_no, sample_no FROM sample_numbers(TABLE(SELECT * FROM {{rows}}) PARTITION BY ({KEY}, {BLOCK}) ORDER BY (pkt_no), "
        f"{int(size)}, {float(span)}D)", rows=entered)


def packet_features(size_order: Window) -> Column:
    """The 11 normalised features of a packet inside its sample."""
    def optional(name: str, default: int) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    one = F.lit(1.0)
    gap = F.coalesce(F.col("ts_s") - F.lag("ts_s").over(size_order), F.lit(0.0))
    return F.array(
        F.least(F.col("packet_size") / 1500.0, one), F.least(gap, one),
        F.when(F.col("protocol") == 6, 1.0).when(F.col("protocol") == 17, 0.5).otherwise(0.0),
        F.col("tcp_flags") / 255.0, F.col("src_port") / 65535.0, F.col("dst_port") / 65535.0,
        optional("direction", 0).cast("double"), F.least(optional("payload_size", 0) / 1500.0, one),
        F.least(optional("header_size", 20) / 60.0, one), F.least(optional("window_size", 0) / 65535.0, one),
        optional("ttl", 64) / 255.0,
    )


OPTIONAL = ["direction", "payload_size", "header_size", "window_size", "ttl"]


def sample_matrices(sampled: DataFrame, size: int = 10, attackers: DataFrame | None = None,
                    victims: DataFrame | None = None) -> DataFrame:
    """One row per sample: the ``size`` x 11 matrix padded with zero rows, and its label.

    The label is 1 when the first packet comes from an attacker or goes to a victim. A
    sample has at most ``size`` packets, which bounds every group.
    """
    for name in OPTIONAL:
        if name not in sampled.columns:
            sampled = sampled.withColumn(name, F.lit(None).cast("int"))
    inside = Window.partitionBy(KEY, "sample_no").orderBy("pkt_no")
    rows = sampled.withColumn("_f", packet_features(inside)).groupBy(KEY, "sample_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pkt_no", "_f"))), lambda p: p["_f"]).alias("_m"),
        F.min_by("src_ip", "pkt_no").alias("_src"), F.min_by("dst_ip", "pkt_no").alias("_dst"),
        F.count(F.lit(1)).alias("packets"), F.min("ts_s").alias("start_time"), F.max("ts_s").alias("end_time"),
    )
    zeros = F.array(*[F.lit(0.0)] * 11)
    padded = F.slice(F.concat("_m", F.array_repeat(zeros, size)), 1, size)
    out = rows.withColumn("matrix", padded)
    label = F.lit(False)
    if attackers is not None:
        out = out.join(attackers.select(F.col("ip").alias("_src"), F.lit(True).alias("_a")).distinct(), "_src", "left")
        label = label | F.coalesce("_a", F.lit(False))
    if victims is not None:
        out = out.join(victims.select(F.col("ip").alias("_dst"), F.lit(True).alias("_v")).distinct(), "_dst", "left")
        label = label | F.coalesce("_v", F.lit(False))
    return out.select(KEY, "sample_no", "packets", "start_time", "end_time", "matrix", label.cast("int").alias("label"))
