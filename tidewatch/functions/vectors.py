"""Fixed-size numeric vectors from packets, flows and connection records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import CICIDS_FEATURES, KDD_FEATURES, KDD_NUMERIC

UNIFIED = 50
WIDE = 115

# --- fixed values: upper ends of the connection features; all others end at 1 -----------
KDD_RANGE = {"duration": 60000.0, "src_bytes": 1e9, "dst_bytes": 1e9, "count": 500.0, "srv_count": 500.0,
             "dst_host_count": 255.0, "dst_host_srv_count": 255.0}


def fit_length(vector: Column, length: int = WIDE) -> Column:
    """Cut to ``length`` or pad with zeros."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), length)), 1, length)


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of a number, the same to the last bit.

    A whole number divided by a power of ten is the nearest double, as it is of the decimal that ``F.round`` goes by. Only near
    ties, where the product may err, and beyond the range of exact products that slower way is taken.
    """
    scale = F.lit(10.0 ** digits)
    at = x * scale
    clear = (F.abs(at) < 1e9) & (F.abs(at - F.floor(at) - 0.5) > 1e-4)
    return F.when(clear, F.floor(at + 0.5) / scale).otherwise(F.round(x, digits))


def _numbers(*values) -> list[Column]:
    return [(v if isinstance(v, Column) else F.col(v)).cast("double") for v in values]


def _fixed(cells: Sequence[Column], length: int) -> Column:
    """An array of exactly ``length`` numbers, built in one go."""
    return F.array(*cells[:length], *[F.lit(0.0)] * (length - len(cells)))


def _octets(ip: str) -> list[Column]:
    """Four numbers of a dotted address; anything else gives zeros."""
    return [F.coalesce(F.split_part(F.col(ip), F.lit("."), F.lit(i)).try_cast("double"), F.lit(0.0)) for i in range(1, 5)]


def packet_basic() -> Column:
    """Size, protocol, ports, flags, eight octets and two clock phases, padded to 115."""
    ts = F.col("ts_s")
    head = _numbers("packet_size", "protocol", "src_port", "dst_port", "tcp_flags")
    clock = _numbers(F.pmod(ts, F.lit(86400.0)), F.pmod(ts, F.lit(3600.0)))
    return _fixed([*head, *_octets("src_ip"), *_octets("dst_ip"), *clock], WIDE)


def text_code(text: Column) -> Column:
    """Stable code 0..999 of a category name."""
    return F.pmod(F.xxhash64(text), F.lit(1000)).cast("double")


def _record(df: DataFrame, names: Sequence[str]) -> Column:
    have = set(df.columns)
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    cells = []
    for n in names:
        if n not in have:
            cells.append(F.lit(0.0))
        elif n in texts:
            cells.append(text_code(F.col(f"`{n}`")))
        else:
            cells.append(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)))
    return _fixed(cells, WIDE)


def connection_basic(df: DataFrame) -> Column:
    return _record(df, KDD_FEATURES)


def flow_meter_basic(df: DataFrame) -> Column:
    return _record(df, CICIDS_FEATURES)


# --- the unified 50-dimensional vector ----------------------------------------------------


def _share(name: str, scale: float) -> Column:
    return F.least(F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)) / scale, F.lit(1.0))


def unified_packet(has_ttl: bool = False) -> Column:
    ttl = F.coalesce(F.col("ttl"), F.lit(64)) if has_ttl else F.lit(64)
    head = _numbers(F.col("packet_size") / 1500.0, F.col("protocol") / 255.0, F.col("src_port") / 65535.0,
                    F.col("dst_port") / 65535.0, F.col("tcp_flags") / 255.0, ttl / 255.0)
    return _fixed([*head, *[x / 255.0 for x in _octets("src_ip") + _octets("dst_ip")]], UNIFIED)


def unified_flow() -> Column:
    return _fixed([
        _share("duration", 60.0), _share("bytes_sent", 1e6), _share("bytes_recv", 1e6), _share("packets_sent", 1000.0),
        _share("packets_recv", 1000.0), F.col("protocol") / 255.0, F.col("src_port") / 65535.0, F.col("dst_port") / 65535.0], UNIFIED)


def unified_connection() -> Column:
    """Rates pass through, the other numbers are scaled by their range and cut at 1."""
    return _fixed([F.col(n).cast("double") if n.endswith("_rate") else _share(n, KDD_RANGE.get(n, 1.0)) for n in KDD_NUMERIC], UNIFIED)


def unified_flow_meter() -> Column:
    return _fixed([
        _share("Flow Duration", 1e6), _share("Total Fwd Packets", 1000.0), _share("Total Backward Packets", 1000.0),
        _share("Flow Bytes/s", 1e8), _share("Flow Packets/s", 1e4)], UNIFIED)


def widen(unified: Column) -> Column:
    """50 to 115: the vector, then its first 13 numbers five times."""
    return F.concat(unified, F.flatten(F.array_repeat(F.slice(unified, 1, 13), 5)))


def to_matrix(unified: Column) -> Column:
    """50 to 10 x 11: row t starts at 5t; rows that would run over the end repeat row 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda t: F.slice(unified, F.when(t * 5 + 11 <= 50, t * 5 + 1).otherwise(1), 11))


def prefix(unified: Column, length: int) -> Column:
    return F.slice(unified, 1, length)


# --- input formats --------------------------------------------------------------------------


def input_format(columns: Sequence[str]) -> str:
    have = set(columns)
    if {"duration", "src_bytes"} <= have:
        return "nslkdd"
    if "Flow Duration" in have:
        return "cicids"
    if {"src_ip", "dst_ip"} <= have:
        return "flow" if have & {"packets_sent", "bytes_sent"} else "raw_packet"
    return "feature_vector"


def row_format(record: Column) -> Column:
    """Format of each row of a map column, from its keys."""
    def has(key: str) -> Column:
        return F.map_contains_key(record, key)

    flow = F.when(has("packets_sent") | has("bytes_sent"), "flow").otherwise("raw_packet")
    return (
        F.when(has("duration") & has("src_bytes"), "nslkdd").when(has("Flow Duration"), "cicids")
        .when(has("src_ip") & has("dst_ip"), flow).otherwise("feature_vector"))


# --- security state ---------------------------------------------------------------------------

# --- fixed values: (field, scale, cut at 1, whole number) -------------------------------------
STATE = [
    ("packet_rate", 10000.0, False, False), ("byte_rate", 1e8, False, False),
    ("unique_src_ips", 1000.0, True, True), ("unique_dst_ports", 100.0, True, True),
    ("syn_ratio", 1.0, False, False), ("avg_packet_size", 1500.0, False, False),
    ("flow_duration", 60.0, True, False), ("threat_score", 1.0, False, False),
    ("anomaly_score", 1.0, False, False), ("reputation_score", 1.0, False, False),
    ("recent_blocks", 100.0, True, True), ("recent_alerts", 100.0, True, True),
    ("false_positives", 10.0, True, True), ("true_positives", 100.0, True, True),
    ("attack_type", 10.0, False, True),
]
STATE_DEFAULT = {"reputation_score": 0.5}


def state_vector(columns: Sequence[str]) -> Column:
    """15 normalised indicators; indicators without a column take their default."""
    cells = []
    for name, scale, cut, _ in STATE:
        value = F.col(name).cast("double") if name in columns else F.lit(STATE_DEFAULT.get(name, 0.0))
        cells.append(F.least(value / scale, F.lit(1.0)) if cut else value / scale)
    return F.array(*cells)


def state_fields(vector: Column) -> list[Column]:
    """The inverse; counts are cut to whole numbers."""
    out = []
    for i, (name, scale, _, whole) in enumerate(STATE):
        value = F.get(vector, F.lit(i)) * scale
        out.append((F.floor(value).cast("bigint") if whole else value).alias(name))
    return out


def enrich_state(state: Column, scores: Column) -> Column:
    """Put the largest score in slot 7 and the mean score in slot 8; no scores, no change."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    changed = F.concat(F.slice(state, 1, 7), F.array(F.array_max(scores), total / F.size(scores)), F.slice(state, 10, 6))
    return F.when(F.size(scores) > 0, changed).otherwise(state)


def decision_state(features: Column, risk: Column, threat: Column, reputation: Column) -> Column:
    return F.concat(features, F.array(risk.cast("double"), threat.cast("double"), reputation.cast("double")))


def traffic_state(packets: DataFrame, window: str = "60 seconds", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Security indicators per target and time window, from packets."""
    timed = packets.withColumn("at", F.timestamp_micros((F.col("ts_s") * 1_000_000).cast("bigint")))
    seconds = float(window.split()[0])
    frame = F.window("at", window, slide) if slide else F.window("at", window)
    grouped = timed.groupBy(frame.alias("w"), "dst_ip").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_size").alias("bytes"),
        F.count_distinct("src_ip").alias("unique_src_ips"), F.count_distinct("dst_port").alias("unique_dst_ports"),
        F.count_if(F.col("tcp_flags").bitwiseAND(F.lit(2)) != 0).alias("_syn"),
        F.min("ts_s").alias("_a"), F.max("ts_s").alias("_z"),
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), "dst_ip",
        (F.col("packets") / seconds).alias("packet_rate"), (F.col("bytes") / seconds).alias("byte_rate"),
        "unique_src_ips", "unique_dst_ports", (F.col("_syn") / F.col("packets")).alias("syn_ratio"),
        (F.col("bytes") / F.col("packets")).alias("avg_packet_size"), (F.col("_z") - F.col("_a")).alias("flow_duration"))


# --- standardisation --------------------------------------------------------------------------


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a deviation below 1e-10 becomes 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) >= 1e-10 else 1.0) for c in columns}


def apply_standard(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})



