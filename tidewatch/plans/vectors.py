"""Damped statistics and feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import vectors as V
from tidewatch.operators import flows as O
from tidewatch.operators import incstats as I
from tidewatch.operators import labels as L
from tidewatch.plans.flows import _FLOWS
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import query
from tidewatch.runtime import spread
from tidewatch.schemas import KDD_CATEGORICAL, KDD_FEATURES, KDD_NUMERIC, PHISHING_FEATURES
from tidewatch.sources.views import connections

_RATES = [repr(r) for r in I.RATES]


def cells(vector: str, n: int, digits: int = 6, name: str = "v"):
    return [V.rounded(F.get(vector, F.lit(i)), digits).alias(f"{name}{i:03d}") for i in range(n)]


_CHAN = """,
chan AS (SELECT pkt_no, ts_s, CAST(packet_size AS DOUBLE) AS x, CAST(tcp_flags AS DOUBLE) AS y, c.channel, CASE c.channel WHEN 'mac' THEN '-' WHEN 'ip' THEN src_ip
  WHEN 'ip_pair' THEN src_ip || '->' || dst_ip WHEN 'socket' THEN src_ip || ':' || src_port
  ELSE src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port END AS key
 FROM packets, (VALUES {chans}) c(channel)),
tau AS (SELECT *, max(ts_s) OVER (PARTITION BY channel, key ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS tau FROM chan)"""


def _damped(chans: list[str], extra: bool = False) -> str:
    sums = []
    for i, r in enumerate(_RATES):
        e = f"exp(-{r}*(a.tau-b.tau))"
        sums += [f"sum({e}) AS w_{i}", f"sum({e}*b.x) AS s_{i}", f"sum({e}*b.x*b.x) AS q_{i}"]
        if extra:
            sums += [f"sum({e}*b.y) AS s2_{i}", f"sum({e}*b.y*b.y) AS q2_{i}", f"sum({e}*b.x*b.y) AS c_{i}"]
    return _CHAN.format(chans=", ".join(f"('{c}')" for c in chans)) + f""",
ds AS (SELECT a.pkt_no, a.channel, any_value(a.ts_s) AS ts_s, any_value(a.x) AS x, {', '.join(sums)}
 FROM tau a JOIN tau b ON a.channel = b.channel AND a.key = b.key AND b.pkt_no <= a.pkt_no GROUP BY a.pkt_no, a.channel)"""


def _var(i: int, s: str = "s", q: str = "q") -> str:
    return f"CASE WHEN w_{i} < 2 THEN 0 ELSE greatest(0, {q}_{i}/w_{i} - ({s}_{i}/w_{i})*({s}_{i}/w_{i})) END"


def _stats(i: int) -> list[str]:
    return [f"w_{i}", f"s_{i}/w_{i}", f"sqrt({_var(i)})"]


_ST = [f"round({e}, {d}) AS {n}_{i}" for i in range(5) for e, n, d in zip(_stats(i), ("weight", "mean", "std"), (6, 6, 3))]


def _statistics_columns():
    return [V.rounded(F.col(f"{n}_{i}"), d).alias(f"{n}_{i}") for i in range(5) for n, d in (("weight", 6), ("mean", 6), ("std", 3))]


@query("damped_source_statistics", "W9 D14", with_views("packets", _damped(["ip"]) + f" SELECT pkt_no, {', '.join(_ST)} FROM ds"))
def damped_source_statistics(t):
    return I.damped_statistics(I.channel_rows(t.packets, ["ip"])).select("pkt_no", *_statistics_columns())


_COV = [f"CASE WHEN w_{i} < 2 THEN 0 ELSE c_{i}/w_{i} - (s_{i}/w_{i})*(s2_{i}/w_{i}) END" for i in range(5)]
_PCC = [f"CASE WHEN w_{i} < 2 OR ({_var(i)}) < 1e-10 OR ({_var(i, 's2', 'q2')}) < 1e-10 THEN 0 ELSE ({_COV[i]})/(sqrt({_var(i)})*sqrt({_var(i, 's2', 'q2')})) END" for i in range(5)]


@query("damped_pair_statistics", "W10", with_views("packets", _damped(["ip_pair"], True) + " SELECT pkt_no, " + ", ".join(
    f"round({_COV[i]}, 4) + 0 AS cov_{i}, round({_PCC[i]}, 4) + 0 AS pcc_{i}" for i in range(4)) + " FROM ds"))
def damped_pair_statistics(t):
    rows = I.channel_rows(t.packets, ["ip_pair"], keep=["tcp_flags"])
    out = I.damped_pair_statistics(rows, "tcp_flags")
    return out.select("pkt_no", *[(F.round(f"{n}_{i}", 4) + F.lit(0.0)).alias(f"{n}_{i}") for i in range(4) for n in ("cov", "pcc")])


_W = [f"w_{i}" for i in range(5)]
_AVG = f"(({' + '.join(_W)})/5)"
_BLOCK = [e for i in range(5) for e in _stats(i)] + [
    _AVG, f"sqrt(({' + '.join(f'({w} - {_AVG})*({w} - {_AVG})' for w in _W)})/5)",
    f"greatest({', '.join(_W)}) - least({', '.join(_W)})", "ln(1 + x)", "(ts_s % 86400)/86400", "(ts_s % 3600)/3600", "(ts_s % 60)/60", "1e0"]


@query("channel_blocks", "W11", with_views("packets", _damped(["socket"]) + " SELECT pkt_no, " + ", ".join(
    f"round({e}, 3) AS v{i:03d}" for i, e in enumerate(_BLOCK)) + " FROM ds"))
def channel_blocks(t):
    rows = I.damped_statistics(I.channel_rows(t.packets, ["socket"])).withColumn("b", I.channel_block())
    return rows.select("pkt_no", *cells("b", 23, 3))


@query("packet_vectors", "W12 D15", with_views("packets", _damped(I.CHANNELS) + " SELECT pkt_no, " + ", ".join(
    f"round(max(CASE WHEN channel = '{c}' THEN {e} END), 3) AS v{j * 23 + i:03d}" for j, c in enumerate(I.CHANNELS) for i, e in enumerate(_BLOCK))
    + " FROM ds GROUP BY pkt_no"))
def packet_vectors(t):
    return I.packet_vectors(t.packets).select("pkt_no", *cells("vector", 115, 3))


@query("current_source_statistics", "E5", with_views("packets", _CHAN.format(chans=", ".join(f"('{c}')" for c in I.CHANNELS)) + """,
now AS (SELECT *, max(ts_s) OVER (PARTITION BY channel, key) AS n FROM chan),
fin AS (SELECT channel, key, count(*) AS packets, """ + ", ".join(
    f"sum(exp(-{r}*(n-ts_s))) AS w_{i}, sum(exp(-{r}*(n-ts_s))*x) AS s_{i}, sum(exp(-{r}*(n-ts_s))*x*x) AS q_{i}" for i, r in enumerate(_RATES))
    + f" FROM now GROUP BY channel, key) SELECT channel, CASE channel WHEN 'mac' THEN '00:00:00:00:00:00->00:00:00:00:00:00' ELSE key END AS key, packets, {', '.join(_ST)} FROM fin"))
def current_source_statistics(t):
    return I.current_statistics(I.channel_rows(t.packets, I.CHANNELS)).select("channel", "key", "packets", *_statistics_columns())


# --- vectors --------------------------------------------------------------------------------


def _octets(ip: str) -> list[str]:
    return [f"CAST(split_part({ip}, '.', {i}) AS DOUBLE)" for i in range(1, 5)]


def _wide(exprs: list[str], n: int, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({exprs[i] if i < len(exprs) else '0'} AS DOUBLE), {digits}) AS v{i:03d}" for i in range(n))


@query("packet_basic_vectors", "V1 V4", with_views("packets", "SELECT pkt_no, " + _wide(
    ["packet_size", "protocol", "src_port", "dst_port", "tcp_flags", *_octets("src_ip"), *_octets("dst_ip"), "ts_s % 86400", "ts_s % 3600"], 115) + " FROM packets"))
def packet_basic_vectors(t):
    return t.packets.withColumn("v", V.packet_basic()).select("pkt_no", *cells("v", 115))


_UP = ["packet_size/1500e0", "protocol/255e0", "src_port/65535e0", "dst_port/65535e0", "tcp_flags/255e0", "64/255e0",
       *[f"{o}/255e0" for o in _octets("src_ip") + _octets("dst_ip")]]


@query("unified_packet_vectors", "V5", with_views("packets", "SELECT pkt_no, " + _wide(_UP, 50) + " FROM packets"))
def unified_packet_vectors(t):
    return t.packets.withColumn("v", V.unified_packet()).select("pkt_no", *cells("v", 50))


_UF = ["least(duration/60e0, 1)", "least(bytes_sent/1e6, 1)", "least(bytes_recv/1e6, 1)", "least(packets_sent/1000e0, 1)", "least(packets_recv/1000e0, 1)",
       "protocol/255e0", "src_port/65535e0", "dst_port/65535e0"]


@query("unified_flow_vectors", "V6", with_views("packets keyed", _FLOWS + " SELECT flow_key, flow_seq, " + _wide(_UF, 50) + " FROM flow_rows"))
def unified_flow_vectors(t):
    return O.flow_table(t.packets).withColumn("v", V.unified_flow()).select("flow_key", "flow_seq", *cells("v", 50))


_NAMES = [*L.ATTACK_NAMES, "zero_day"]


def _kdd_sql() -> str:
    out = []
    for j, name in enumerate(KDD_FEATURES):
        if name == "protocol_type":
            e = "CASE l_returnflag WHEN 'A' THEN 'udp' WHEN 'R' THEN 'icmp' ELSE 'tcp' END"
        elif name == "service":
            e = "'svc_' || CAST(l_partkey % 9 AS VARCHAR)"
        elif name == "flag":
            e = "CASE l_linestatus WHEN 'O' THEN 'SF' ELSE 'S0' END"
        elif name == "duration":
            e = "l_quantity * 10"
        elif name in ("src_bytes", "dst_bytes"):
            e = f"floor(l_extendedprice * {j + 1})"
        elif name.endswith("_rate"):
            e = f"((l_orderkey * {j + 1} + l_partkey) % 101) / 100e0"
        else:
            e = f"CAST((l_orderkey * {j + 2} + l_suppkey) % {300 if 'count' in name else 3} AS DOUBLE)"
        out.append(f'{e} AS "{name}"')
    return "conns AS (SELECT l_orderkey AS flow_no, l_linenumber AS flow_line, " + ", ".join(out) + " FROM lineitem)"


CONNS = _kdd_sql()


def connection_rows(t):
    return connections(spread(t.lineitem), _NAMES)


_UK = [f'"{n}"' if n.endswith("_rate") else f'least("{n}"/{V.KDD_RANGE.get(n, 1.0)!r}, 1)' for n in KDD_NUMERIC]


@query("unified_connection_vectors", "V7", f"WITH {CONNS} SELECT flow_no, flow_line, {_wide(_UK, 50, 9)} FROM conns")
def unified_connection_vectors(t):
    return connection_rows(t).withColumn("v", V.unified_connection()).select("flow_no", "flow_line", *cells("v", 50, 9))


_METER = {"Flow Duration": "l_quantity * 40000", "Total Fwd Packets": "CAST(l_partkey % 1500 AS DOUBLE)", "Total Backward Packets": "CAST(l_suppkey % 700 AS DOUBLE)",
          "Flow Bytes/s": "l_extendedprice * 2000", "Flow Packets/s": "l_extendedprice / 5"}
_UM = ["least(l_quantity*40000/1e6, 1)", "least((l_partkey % 1500)/1000e0, 1)", "least((l_suppkey % 700)/1000e0, 1)", "least(l_extendedprice*2000/1e8, 1)", "least(l_extendedprice/5/1e4, 1)"]


def meter_rows(t):
    return spread(t.lineitem).select(F.col("l_orderkey").alias("flow_no"), F.col("l_linenumber").alias("flow_line"),
                                     *[F.expr(e).alias(n) for n, e in _METER.items()])


@query("unified_flow_meter_vectors", "V8 D18", f"SELECT l_orderkey AS flow_no, l_linenumber AS flow_line, {_wide(_UM, 50)} FROM lineitem")
def unified_flow_meter_vectors(t):
    return meter_rows(t).withColumn("v", V.unified_flow_meter()).select("flow_no", "flow_line", *cells("v", 50))


@query("connection_basic_vectors", "V2")
def connection_basic_vectors(t):
    rows = connection_rows(t)
    return rows.select("flow_no", "flow_line", V.connection_basic(rows).alias("vector"))


@query("flow_meter_basic_vectors", "V3")
def flow_meter_basic_vectors(t):
    rows = meter_rows(t)
    return rows.select("flow_no", "flow_line", V.flow_meter_basic(rows).alias("vector"))


_UP14 = _UP + ["0"] * 36


@query("widened_packet_vectors", "V9 V11", with_views("packets", "SELECT pkt_no, " + _wide(_UP14 + _UP14[:13] * 5, 115) + " FROM packets"))
def widened_packet_vectors(t):
    return t.packets.withColumn("v", V.widen(V.unified_packet())).select("pkt_no", *cells("v", 115))


_ROWS = [(_UP14[t * 5:t * 5 + 11] if t * 5 + 11 <= 50 else _UP14[:11]) for t in range(10)]


@query("packet_step_matrices", "V10", with_views("packets", "SELECT pkt_no, " + _wide([c for r in _ROWS for c in r], 110) + " FROM packets"))
def packet_step_matrices(t):
    return t.packets.withColumn("v", F.flatten(V.to_matrix(V.unified_packet()))).select("pkt_no", *cells("v", 110))


@query("packet_prefix_vectors", "V11", with_views("packets", "SELECT pkt_no, " + _wide(_UP14, 16) + " FROM packets"))
def packet_prefix_vectors(t):
    return t.packets.withColumn("v", V.prefix(V.unified_packet(), 16)).select("pkt_no", *cells("v", 16))


_MEAS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standardized_measures", "V12 M12", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem))/(SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}" for c in _MEAS) + " FROM lineitem")
def standardized_measures(t):
    params = V.fit_standard(t.lineitem, _MEAS)
    return V.apply_standard(t.lineitem, params).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _MEAS])


_STATE_SQL = """,
st AS (SELECT floor(ts_s/60) AS w, dst_ip, count(*)/60e0 AS packet_rate, sum(packet_size)/60e0 AS byte_rate, count(DISTINCT src_ip) AS unique_src_ips,
 count(DISTINCT dst_port) AS unique_dst_ports, count(*) FILTER ((tcp_flags & 2) <> 0)*1e0/count(*) AS syn_ratio, sum(packet_size)*1e0/count(*) AS avg_packet_size,
 max(ts_s) - min(ts_s) AS flow_duration FROM packets GROUP BY 1, 2)"""
_S15 = ["packet_rate/10000", "byte_rate/1e8", "least(unique_src_ips/1000e0, 1)", "least(unique_dst_ports/100e0, 1)", "syn_ratio", "avg_packet_size/1500",
        "least(flow_duration/60, 1)", "0", "0", "0.5e0"]


def state_rows(t):
    rows = V.traffic_state(t.packets)
    return rows.withColumn("w", F.unix_seconds("window_start") / 60).withColumn("v", V.state_vector(rows.columns))


@query("security_states", "V14 V15 D21", with_views("packets", _STATE_SQL) + f" SELECT CAST(w AS DOUBLE) AS w, dst_ip, {_wide(_S15, 15)} FROM st")
def security_states(t):
    return state_rows(t).select("w", "dst_ip", *cells("v", 15))


_BACK = ["round(packet_rate, 4) AS packet_rate", "round(byte_rate, 4) AS byte_rate", "CAST(floor(least(unique_src_ips/1000e0, 1)*1000) AS BIGINT) AS unique_src_ips",
         "CAST(floor(least(unique_dst_ports/100e0, 1)*100) AS BIGINT) AS unique_dst_ports", "round(flow_duration/60*60, 4) AS flow_duration"]


@query("security_state_inverse", "V14", with_views("packets", _STATE_SQL) + f" SELECT CAST(w AS DOUBLE) AS w, dst_ip, {', '.join(_BACK)} FROM st")
def security_state_inverse(t):
    rows = state_rows(t).select("w", "dst_ip", *V.state_fields(F.col("v")))
    return rows.select("w", "dst_ip", *[F.round(c, 4).alias(c) for c in ("packet_rate", "byte_rate", "flow_duration")], "unique_src_ips", "unique_dst_ports")


@query("enriched_states", "R26", with_views("traffic model_scores", """SELECT id, round(greatest(coalesce(statistical,0), coalesce(text,0), coalesce(visual,0)), 6) AS v007,
 round((coalesce(statistical,0) + coalesce(text,0) + coalesce(visual,0))/3, 6) AS v008, 0.5e0 AS v009, """ + ", ".join(f"0e0 AS v{i:03d}" for i in (*range(7), *range(10, 15))) + " FROM model_scores"))
def enriched_states(t):
    scores = F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("statistical", "text", "visual")])
    rows = t.model_scores.withColumn("v", V.enrich_state(V.state_vector([]), scores))
    return rows.select("id", *cells("v", 15))


@query("decision_states", "V17", with_views("phishing", "SELECT row_id, " + ", ".join(
    f'coalesce("{c}", 0)*1e0 AS v{i:03d}' for i, c in enumerate(PHISHING_FEATURES)) + ', 0.25e0 AS v030, CAST("Result" AS DOUBLE) AS v031, 0.5e0 AS v032 FROM phishing'))
def decision_states(t):
    features = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in PHISHING_FEATURES])
    rows = t.phishing.withColumn("v", V.decision_state(features, F.lit(0.25), F.col("Result"), F.lit(0.5)))
    return rows.select("row_id", *cells("v", 33))





@query("row_input_formats", "F12", """SELECT id, CASE id % 5 WHEN 0 THEN 'nslkdd' WHEN 1 THEN 'cicids' WHEN 2 THEN 'flow' WHEN 3 THEN 'raw_packet' ELSE 'feature_vector' END AS format
FROM (SELECT event_id AS id FROM events)""")
def row_input_formats(t):
    def keys(*names):
        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col("value")] * len(names)))

    n = F.col("event_id") % 5
    record = (F.when(n == 0, keys("duration", "src_bytes")).when(n == 1, keys("Flow Duration", "x")).when(n == 2, keys("src_ip", "dst_ip", "bytes_sent"))
              .when(n == 3, keys("src_ip", "dst_ip")).otherwise(keys("a")))
    return t.events.select(F.col("event_id").alias("id"), V.row_format(record).alias("format"))


@query("connection_label_codes", "V16", f"WITH {CONNS} SELECT flow_no, flow_line, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY \"{c}\") - 1 AS DOUBLE) AS {c}_code" for c in KDD_CATEGORICAL) + " FROM conns x")
def connection_label_codes(t):
    from tidewatch.operators.learn import label_codes

    rows = label_codes(connection_rows(t), KDD_CATEGORICAL)
    return rows.select("flow_no", "flow_line", *[f"{c}_code" for c in KDD_CATEGORICAL])
