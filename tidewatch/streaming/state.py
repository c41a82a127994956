"""Keyed streaming state: flow assembly, flow samples and behaviour profiles.

A micro-batch delivers the rows of a key unordered; they are sorted by arrival inside the
handler, so a batch must be small enough for the rows one key has in it (bounded by the
trigger of the source). The state per key is a few numbers, except for the sets behind the
distinct counts, which live in RocksDB map state.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.flow import FLAG_BITS, flow_key, profile_score, score_columns
from tidewatch.operators.flows import walk

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLAGS = ["syn", "ack", "fin", "rst", "psh"]


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory goes to local disk with checkpoints in the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _event_time(packets: DataFrame, delay: str) -> DataFrame:
    at = F.timestamp_micros((F.col("ts_s") * 1_000_000).cast("bigint"))
    return packets.withColumn("flow_key", flow_key()).withColumn("at", at).withWatermark("at", delay)


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(rows).sort_values(by)


# --- flows ---------------------------------------------------------------------------------

FLOW = T.StructType(
    [T.StructField("flow_key", T.StringType()), T.StructField("flow_seq", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("src_ip", "dst_ip")]
    + [T.StructField(n, T.IntegerType()) for n in ("src_port", "dst_port", "protocol")]
    + [T.StructField(n, T.DoubleType()) for n in ("start_time", "end_time")]
    + [T.StructField(n, T.LongType()) for n in ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv")]
    + [T.StructField(f"{n}_count", T.LongType()) for n in FLAGS])
_OPEN = T.StructType([*FLOW.fields[1:], T.StructField("is_open", T.BooleanType())])


class _Flows(StatefulProcessor):
    def __init__(self, idle: float) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", _OPEN)

    def _due(self, flow: dict) -> int:
        return int((flow["end_time"] + self.idle) * 1000) + 1

    def _save(self, flow: dict, old_timer: int | None) -> None:
        if old_timer is not None:
            self.handle.deleteTimer(old_timer)
        if flow["is_open"]:
            self.handle.registerTimer(self._due(flow))
        self.open.update(tuple(flow[f.name] for f in _OPEN.fields))

    def _load(self) -> dict | None:
        return dict(zip(_OPEN.names, self.open.get())) if self.open.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flow, done = self._load(), []
        old_timer = self._due(flow) if flow and flow["is_open"] else None

        def finish() -> None:
            done.append((key[0], *[flow[n] for n in FLOW.names[1:]]))
            flow["is_open"] = False

        for p in _sorted(rows, ["pkt_no"]).itertuples(index=False):
            if flow and flow["is_open"] and p.ts_s - flow["end_time"] > self.idle:
                finish()
            if flow is None or not flow["is_open"]:
                seq = flow["flow_seq"] + 1 if flow else 1
                flow = {n: 0 for n in _OPEN.names}
                flow.update(flow_seq=seq, src_ip=p.src_ip, dst_ip=p.dst_ip, src_port=int(p.src_port), dst_port=int(p.dst_port),
                            protocol=int(p.protocol), start_time=float(p.ts_s), is_open=True)
            side = "sent" if p.src_ip == flow["src_ip"] else "recv"
            flow[f"bytes_{side}"] += int(p.packet_size)
            flow[f"packets_{side}"] += 1
            flow["end_time"] = float(p.ts_s)
            flags = int(p.tcp_flags)
            for n in FLAGS:
                flow[f"{n}_count"] += int(bool(flags & FLAG_BITS[n]))
            if flags & (FLAG_BITS["fin"] | FLAG_BITS["rst"]):
                finish()
        self._save(flow, old_timer)
        yield pd.DataFrame(done, columns=FLOW.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flow = self._load()
        done = []
        if flow and flow["is_open"] and self._due(flow) <= expiredTimerInfo.getExpiryTimeInMs():
            done.append((key[0], *[flow[n] for n in FLOW.names[1:]]))
            flow["is_open"] = False
            self.open.update(tuple(flow[f.name] for f in _OPEN.fields))
        yield pd.DataFrame(done, columns=FLOW.names)

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, idle: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """Finished flows: closed by FIN/RST, by a later packet, or once the watermark is more
    than ``idle`` seconds past their last packet."""
    use_rocksdb(packets.sparkSession)
    return _event_time(packets, delay).groupBy("flow_key").transformWithStateInPandas(
        _Flows(idle), FLOW, "append", "EventTime")


# --- samples ----------------------------------------------------------------------------------

SAMPLE = T.StructType([
    T.StructField("flow_key", T.StringType()), T.StructField("sample_no", T.LongType()), T.StructField("packets", T.IntegerType()),
    T.StructField("first_packet", T.LongType()), T.StructField("last_packet", T.LongType()),
    T.StructField("matrix", T.ArrayType(T.DoubleType()))])
_HELD = T.StructType(
    [T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("next", T.ArrayType(T.LongType())), T.StructField("due", T.ArrayType(T.LongType())),
     T.StructField("held", T.ArrayType(T.LongType())), T.StructField("pkt_no", T.ArrayType(T.LongType())), T.StructField("ts_s", T.ArrayType(T.DoubleType())),
     T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("timer", T.LongType())])
#: Buckets of flow keys: their samples are cut together, since every call to the state is a trip to another process.
KEY_BUCKETS = 4096
CELLS = 11


class _Samples(StatefulProcessor):
    """Samples of the flow keys of a bucket. The state holds, for every key, the number of its next sample, when an open one is
    flushed and how many packets that holds; their numbers, times and features lie in a row."""

    def __init__(self, size: int, span: float, idle_flush: float) -> None:
        self.size, self.span, self.idle_flush = size, span, idle_flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("held", _HELD)

    def _load(self) -> tuple:
        keys, number, due, held, pkt, ts, f, timer = self.state.get() or ([], [], [], [], [], [], [], -1)
        features = np.array(f, float).reshape(len(pkt), CELLS - 1)
        return (np.array(keys, object), *(np.array(x, np.int64) for x in (number, due, held, pkt)), np.array(ts, float), features, timer)

    def _save(self, keys, number, due, held, pkt, ts, f, old_timer: int) -> None:
        open_ = due[due >= 0]
        timer = int(open_.min()) if len(open_) else -1
        if timer != old_timer:
            if old_timer >= 0:
                self.handle.deleteTimer(old_timer)
            if timer >= 0:
                self.handle.registerTimer(timer)
        self.state.update((keys.tolist(), number.tolist(), due.tolist(), held.tolist(), pkt.tolist(), ts.tolist(), f.ravel().tolist(), timer))

    def _rows(self, keys, owner, number, pkt, ts, f) -> pd.DataFrame:
        """One row per sample; the packets of a sample follow each other."""
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
        starts = np.flatnonzero(fresh)
        sizes, sample = np.diff(np.append(starts, len(owner))), np.cumsum(fresh) - 1
        place = np.arange(len(owner)) - starts[sample]
        cells = np.zeros((len(starts), self.size, CELLS))
        cells[sample, place, 0] = f[:, 0]
        cells[sample, place, 1] = np.where(fresh, 0.0, np.minimum(np.diff(ts, prepend=ts[:1]), 1.0))
        cells[sample, place, 2:] = f[:, 1:]
        return pd.DataFrame({"flow_key": keys[owner[starts]], "sample_no": number[starts], "packets": sizes.astype(np.int32), "first_packet": pkt[starts],
                             "last_packet": pkt[starts + sizes - 1], "matrix": pd.Series(list(cells.reshape(len(starts), self.size * CELLS)), dtype=object)}, columns=SAMPLE.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, number, _, held, pkt, ts, f, timer = self._load()
        new = pd.concat(rows)
        known, before = len(keys), len(pkt)
        codes, names = pd.factorize(np.concatenate([keys, new["flow_key"].to_numpy(object)]), use_na_sentinel=False)
        owner = np.concatenate([np.repeat(np.arange(known), held), codes[known:]])
        pkt = np.concatenate([pkt, new["pkt_no"].to_numpy(np.int64)])
        ts = np.concatenate([ts, new["ts_s"].to_numpy(float)])
        f = np.concatenate([f, np.stack(new["f"].to_numpy()).astype(float)])
        # packets of an open sample come first, in their order
        late = np.arange(len(pkt)) >= before
        order = np.lexsort((np.where(late, pkt, np.arange(len(pkt))), late, owner))
        owner, pkt, ts, f = owner[order], pkt[order], ts[order], f[order]
        number = np.concatenate([number, np.zeros(len(names) - known, np.int64)])
        due, held = np.full(len(names), -1, np.int64), np.zeros(len(names), np.int64)
        sample, open_ = np.empty(len(pkt), np.int64), np.zeros(len(pkt), bool)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pkt)]):
            k = owner[a]
            numbers, left, _ = walk(ts[a:b], self.size, self.span, 0, 0.0)
            sample[a:b] = numbers + number[k]
            number[k] = sample[b - 1] + (0 if left else 1)
            if left:
                open_[b - left:b], held[k] = True, left
                due[k] = int((ts[b - 1] + self.idle_flush) * 1000) + 1
        done = self._rows(names, owner[~open_], sample[~open_], pkt[~open_], ts[~open_], f[~open_])
        self._save(names, number, due, held, pkt[open_], ts[open_], f[open_], timer)
        yield done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, number, due, held, pkt, ts, f, timer = self._load()
        late = (due >= 0) & ((due <= expiredTimerInfo.getExpiryTimeInMs()) | (due < timerValues.getCurrentWatermarkInMs()))
        owner = np.repeat(np.arange(len(keys)), held)
        gone = late[owner]
        done = self._rows(keys, owner[gone], number[owner[gone]], pkt[gone], ts[gone], f[gone])
        self._save(keys, number + late, np.where(late, -1, due), np.where(late, 0, held), pkt[~gone], ts[~gone], f[~gone], timer)
        yield done

    def close(self) -> None:
        pass


def stream_samples(packets: DataFrame, size: int = 10, span: float = 10.0, idle_flush: float = 600.0, delay: str = "0 seconds") -> DataFrame:
    """Closed flow samples with their matrix. Leftovers are flushed after ``idle_flush``
    seconds without a packet, which bounds the state. State lies in buckets of keys."""
    use_rocksdb(packets.sparkSession)

    def optional(name: str, default: int):
        return F.coalesce(F.col(name), F.lit(default)) if name in packets.columns else F.lit(default)

    one = F.lit(1.0)
    features = F.array(
        F.least(F.col("packet_size") / 1500.0, one), F.when(F.col("protocol") == 6, 1.0).when(F.col("protocol") == 17, 0.5).otherwise(0.0),
        F.col("tcp_flags") / 255.0, F.col("src_port") / 65535.0, F.col("dst_port") / 65535.0, optional("direction", 0).cast("double"),
        F.least(optional("payload_size", 0) / 1500.0, one), F.least(optional("header_size", 20) / 60.0, one),
        F.least(optional("window_size", 0) / 65535.0, one), optional("ttl", 64) / 255.0)
    bucket = F.pmod(F.xxhash64("flow_key"), F.lit(KEY_BUCKETS)).cast("int")
    rows = _event_time(packets, delay).select("flow_key", "at", "pkt_no", "ts_s", features.alias("f"), bucket.alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Samples(size, span, idle_flush), SAMPLE, "append", "EventTime")


# --- behaviour --------------------------------------------------------------------------------

COUNTS = ["total_flows", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "tcp_flows", "udp_flows", "icmp_flows"]
DISTINCT = ["unique_dst_ports", "unique_dst_ips", "unique_src_ports", "active_hours"]
#: Buckets of the values that a source has shown, by kind: a batch asks once per bucket, and holds one at a time.
BUCKETS = 32
_PROFILE = T.StructType([T.StructField(n, T.LongType()) for n in COUNTS + DISTINCT] + [T.StructField("first_seen", T.DoubleType())])


class _Profiles(StatefulProcessor):
    def __init__(self, order: list[str], names: list[str]) -> None:
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", _PROFILE)
        place = T.StructType([T.StructField("kind", T.StringType()), T.StructField("bucket", T.IntegerType())])
        self.seen = handle.getMapState("seen", place, T.StructType([T.StructField("x", T.ArrayType(T.StringType()))]))

    def _new(self, kind: str, values: list[str], known: bool) -> set[str]:
        """Which of some different values the source has not shown before; they are kept. Every call to the
        state is a trip to another process, so values travel by bucket."""
        buckets: dict[int, list[str]] = {}
        for v in values:
            buckets.setdefault(zlib.crc32(v.encode()) % BUCKETS, []).append(v)
        out: set[str] = set()
        for b, own in buckets.items():
            held = list(self.seen.getValue((kind, b))[0]) if known and self.seen.containsKey((kind, b)) else []
            fresh = set(own).difference(held)
            if fresh:
                self.seen.updateValue((kind, b), ([*held, *sorted(fresh)],))
                out |= fresh
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.profile.get() if self.profile.exists() else None
        pdf = _sorted(rows, self.order).reset_index(drop=True)
        old = dict(zip(_PROFILE.names, state)) if state else {n: 0 for n in COUNTS + DISTINCT}
        proto = pdf["protocol"]
        added = {"total_flows": 1, **{n: pdf[n] for n in COUNTS[1:5]}, "tcp_flows": proto == 6, "udp_flows": proto == 17, "icmp_flows": proto == 1}
        out = pdf.copy()
        for n in COUNTS:
            step = pd.Series(1, index=pdf.index) if n == "total_flows" else added[n].astype("int64")
            out[n] = step.cumsum() + int(old[n])
        values = {"unique_dst_ports": pdf["dst_port"].where(pdf["dst_port"] != 0), "unique_dst_ips": pdf["dst_ip"].where(pdf["dst_ip"] != ""),
                  "unique_src_ports": pdf["src_port"].where(pdf["src_port"] != 0), "active_hours": (pdf["seen_s"] % 86400 // 3600)}
        for kind, column in values.items():
            text = column.map(lambda v: None if pd.isna(v) else (str(int(v)) if not isinstance(v, str) else v))
            first = ~text.duplicated() & text.notna()
            first &= text.isin(self._new(kind, text[first].tolist(), state is not None))
            out[kind] = first.astype("int64").cumsum() + int(old[kind])
        start = float(old["first_seen"]) if state else float(pdf["seen_s"].iloc[0])
        out["first_seen"], out["last_seen"] = start, pdf["seen_s"]
        last = out.iloc[-1]
        self.profile.update((*[int(last[n]) for n in COUNTS + DISTINCT], start))
        yield out[self.names]

    def close(self) -> None:
        pass


def stream_profiles(contacts: DataFrame, order: list[str]) -> DataFrame:
    """The behaviour profile of the source as of every row, with its scores."""
    use_rocksdb(contacts.sparkSession)
    new = [n for n in [*COUNTS, *DISTINCT, "first_seen", "last_seen"] if n not in contacts.columns]
    fields = [*contacts.schema.fields] + [T.StructField(n, T.DoubleType() if n.endswith("seen") else T.LongType()) for n in new]
    names = [f.name for f in fields]
    rows = contacts.groupBy("src_ip").transformWithStateInPandas(_Profiles(order, names), T.StructType(fields), "append", "None")
    return rows.withColumns(score_columns()).withColumn("behavior_score", profile_score())
