"""Flow keys, flow vectors and behaviour scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: bits of the TCP flags ----------------------------------------------
FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10}


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def closes_flow(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(FLAG_BITS["fin"] | FLAG_BITS["rst"])) != 0


def swapped() -> Column:
    """Whether the source is the larger endpoint: address as text, then port as number."""
    a, b = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    return a > b


def flow_key() -> Column:
    """One key for both directions: the smaller endpoint first, then the protocol."""
    def end(side: str) -> Column:
        return F.concat_ws(":", F.col(f"{side}_ip"), F.col(f"{side}_port").cast("string"))

    src, dst, proto = end("src"), end("dst"), F.col("protocol").cast("string")
    return F.when(swapped(), F.concat_ws("-", dst, src, proto)).otherwise(F.concat_ws("-", src, dst, proto))


def flow_vector() -> Column:
    """16 numbers of a finished flow."""
    names = ["duration", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "avg_packet_size",
             "bytes_per_second", "packets_per_second", "syn_count", "ack_count", "fin_count",
             "rst_count", "psh_count", "protocol"]
    return F.array(*[F.col(n).cast("double") for n in names],
                   F.col("src_port") / 65535.0, F.col("dst_port") / 65535.0)


# --- behaviour scores; inputs are the columns of a behaviour profile ------------------


def port_scan_score() -> Column:
    flows, ports, ips = F.col("total_flows"), F.col("unique_dst_ports"), F.col("unique_dst_ips")
    hit = (flows >= 5) & (ports > 20) & (ports / flows > 0.5) & (ips / flows < 0.3)
    return F.when(hit, F.least(F.lit(1.0), ports / 100.0)).otherwise(0.0)


def flood_score() -> Column:
    life = F.col("last_seen") - F.col("first_seen")
    pps, bps = F.try_divide(F.col("packets_sent"), life), F.try_divide(F.col("bytes_sent"), life)
    by_packets = F.when(pps > 1000, F.least(F.lit(1.0), pps / 10_000)).otherwise(0.0)
    by_bytes = F.when(bps > 1e7, F.least(F.lit(1.0), bps / 1e8)).otherwise(0.0)
    one_target = (F.col("unique_dst_ips") == 1) & (F.col("total_flows") > 100)
    raw = F.greatest(by_packets, by_bytes) * F.when(one_target, 1.5).otherwise(1.0)
    return F.when(life >= 1, F.least(F.lit(1.0), raw)).otherwise(0.0)


def beacon_score() -> Column:
    return F.when((F.col("total_flows") >= 10) & (F.col("active_hours") >= 20), 0.3).otherwise(0.0)


def exfiltration_score() -> Column:
    ratio = F.col("bytes_sent") / F.greatest(F.col("bytes_recv"), F.lit(1))
    return F.when((F.col("bytes_sent") > 1_000_000) & (ratio > 10), F.least(F.lit(1.0), ratio / 100.0)).otherwise(0.0)


SCORES = {"port_scan": port_scan_score, "ddos": flood_score, "c2": beacon_score, "data_exfil": exfiltration_score}


def score_columns() -> dict[str, Column]:
    return {f"{name}_score": make() for name, make in SCORES.items()}


def profile_score() -> Column:
    return F.greatest(*[F.col(f"{name}_score") for name in SCORES])
