"""Flows, samples, behaviour profiles, reputation and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.flow import flow_vector
from tidewatch.operators import behavior as B
from tidewatch.operators import flows as O
from tidewatch.operators.scans import with_value_block
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import query


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_SESS = """,
w4a AS (SELECT *, lag(ts_s) OVER w AS pts, lag(tcp_flags) OVER w AS pfl FROM keyed WINDOW w AS (PARTITION BY flow_key ORDER BY pkt_no)),
w4b AS (SELECT *, CASE WHEN pts IS NULL OR ts_s - pts > 60 OR (pfl & 5) <> 0 THEN 1 ELSE 0 END AS starts FROM w4a),
w4 AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY flow_key ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_seq FROM w4b)"""
_FLOWS = _SESS + """,
w5 AS (SELECT *, first_value(src_ip) OVER (PARTITION BY flow_key, flow_seq ORDER BY pkt_no) AS opener FROM w4),
fl AS (SELECT flow_key, flow_seq, arg_min(src_ip, pkt_no) AS src_ip, arg_min(dst_ip, pkt_no) AS dst_ip, arg_min(src_port, pkt_no) AS src_port,
 arg_min(dst_port, pkt_no) AS dst_port, arg_min(protocol, pkt_no) AS protocol,
 arg_max(ts_s, pkt_no) - arg_min(ts_s, pkt_no) AS duration,
 CAST(coalesce(sum(packet_size) FILTER (src_ip = opener), 0) AS BIGINT) AS bytes_sent, CAST(coalesce(sum(packet_size) FILTER (src_ip <> opener), 0) AS BIGINT) AS bytes_recv,
 count(*) FILTER (src_ip = opener) AS packets_sent, count(*) FILTER (src_ip <> opener) AS packets_recv,
 count(*) FILTER ((tcp_flags & 2) <> 0) AS syn_count, count(*) FILTER ((tcp_flags & 16) <> 0) AS ack_count, count(*) FILTER ((tcp_flags & 1) <> 0) AS fin_count,
 count(*) FILTER ((tcp_flags & 4) <> 0) AS rst_count, count(*) FILTER ((tcp_flags & 8) <> 0) AS psh_count,
 CAST(sum(packet_size) AS DOUBLE) AS tb, count(*) AS tp FROM w5 GROUP BY flow_key, flow_seq),
flow_rows AS (SELECT *, tb/tp AS avg_packet_size, CASE WHEN duration > 0 THEN tb/duration ELSE 0 END AS bytes_per_second,
 CASE WHEN duration > 0 THEN tp/duration ELSE 0 END AS packets_per_second FROM fl)"""
_FLOW_COLS = ["flow_key", "flow_seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent", "bytes_recv",
              "packets_sent", "packets_recv", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count"]
_FLOW_REAL = ["duration", "avg_packet_size", "bytes_per_second", "packets_per_second"]


@query("packet_flow_keys", "W1", with_views("packets keyed", "SELECT flow_key, count(*) AS packets, CAST(sum(packet_size) AS BIGINT) AS bytes FROM keyed GROUP BY 1"))
def packet_flow_keys(t):
    return O.keyed(t.packets).groupBy("flow_key").agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_size").alias("bytes"))


@query("packet_directions", "W3 W4", with_views("packets keyed", _SESS + """
SELECT pkt_no, flow_key, flow_seq, starts, first_value(src_ip) OVER (PARTITION BY flow_key, flow_seq ORDER BY pkt_no) = src_ip AS is_forward FROM w4"""))
def packet_directions(t):
    return O.with_direction(O.assemble(t.packets)).select("pkt_no", "flow_key", "flow_seq", "starts", "is_forward")


@query("assembled_flows", "W4 A13 A14 D10", with_views("packets keyed", _FLOWS + "SELECT " + ", ".join(_FLOW_COLS)
       + ", " + ", ".join(f"round({c}, 4) AS {c}" for c in _FLOW_REAL) + " FROM flow_rows"))
def assembled_flows(t):
    return rounded(O.flow_table(t.packets), *_FLOW_REAL, digits=4).select(*_FLOW_COLS, *_FLOW_REAL)


_VEC = [*("duration bytes_sent bytes_recv packets_sent packets_recv avg_packet_size bytes_per_second packets_per_second syn_count "
          "ack_count fin_count rst_count psh_count protocol").split(), "src_port / 65535e0", "dst_port / 65535e0"]


@query("flow_vectors", "V13", with_views("packets keyed", _FLOWS + "SELECT flow_key, flow_seq, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 4) AS v{i:02d}" for i, c in enumerate(_VEC)) + " FROM flow_rows"))
def flow_vectors(t):
    flows = O.flow_table(t.packets).withColumn("v", flow_vector())
    return flows.select("flow_key", "flow_seq", *[F.round(F.get("v", F.lit(i)), 4).alias(f"v{i:02d}") for i in range(16)])


_GREEDY = """,
seq AS (SELECT flow_key, pkt_no, ts_s, row_number() OVER (PARTITION BY flow_key ORDER BY pkt_no) AS rn FROM keyed),
walk AS (SELECT flow_key, pkt_no, rn, ts_s, CAST(0 AS BIGINT) AS sample_no, 1 AS held, ts_s AS start, 1 >= {n} AS closed FROM seq WHERE rn = 1
 UNION ALL SELECT s.flow_key, s.pkt_no, s.rn, s.ts_s, w.sample_no + CAST(w.closed AS INT), CASE WHEN w.closed THEN 1 ELSE w.held + 1 END,
  CASE WHEN w.closed THEN s.ts_s ELSE w.start END,
  (CASE WHEN w.closed THEN 1 ELSE w.held + 1 END) >= {n} OR (NOT w.closed AND s.ts_s - w.start >= {t})
  FROM walk w JOIN seq s ON s.flow_key = w.flow_key AND s.rn = w.rn + 1),
sampled AS (SELECT k.*, w.sample_no FROM keyed k JOIN walk w USING (flow_key, pkt_no))"""


@query("flow_samples", "W5", with_views("packets keyed", _GREEDY.format(n=10, t=10) + """
SELECT flow_key, sample_no, count(*) AS packets, min(pkt_no) AS first_packet, max(pkt_no) AS last_packet FROM sampled GROUP BY 1, 2""", recursive=True))
def flow_samples(t):
    rows = O.assign_samples(t.packets, 10, 10.0)
    return rows.groupBy("flow_key", "sample_no").agg(
        F.count(F.lit(1)).alias("packets"), F.min("pkt_no").alias("first_packet"), F.max("pkt_no").alias("last_packet"))


@query("flow_samples_by_count", "W5", with_views("packets keyed", _GREEDY.format(n=5, t=60) + """
SELECT flow_key, sample_no, count(*) AS packets, min(pkt_no) AS first_packet, max(pkt_no) AS last_packet FROM sampled GROUP BY 1, 2""", recursive=True))
def flow_samples_by_count(t):
    rows = O.assign_samples(t.packets, 5, 60.0)
    return rows.groupBy("flow_key", "sample_no").agg(
        F.count(F.lit(1)).alias("packets"), F.min("pkt_no").alias("first_packet"), F.max("pkt_no").alias("last_packet"))


@query("flow_samples_by_function", "E6", with_views("packets keyed", _GREEDY.format(n=5, t=60) + " SELECT pkt_no, sample_no FROM sampled", recursive=True))
def flow_samples_by_function(t):
    return O.sample_numbers_by_function(t.packets, 5, 60.0)


_PF = ["least(packet_size/1500e0, 1)", "least(coalesce(ts_s - lag(ts_s) OVER w, 0), 1)",
       "CASE protocol WHEN 6 THEN 1e0 WHEN 17 THEN 0.5e0 ELSE 0e0 END", "tcp_flags/255e0", "src_port/65535e0", "dst_port/65535e0",
       "0e0", "0e0", "20/60e0", "0e0", "64/255e0"]


@query("sample_matrix_cells", "W2 W6 W7 D11", with_views("packets keyed", _GREEDY.format(n=5, t=60) + ",\nfeat AS (SELECT *, row_number() OVER w AS pos, "
       + ", ".join(f"{e} AS f{i}" for i, e in enumerate(_PF)) + " FROM sampled WINDOW w AS (PARTITION BY flow_key, sample_no ORDER BY pkt_no))\n"
       + "SELECT flow_key, sample_no, count(*) AS packets, "
       + ", ".join(f"round(coalesce(max(CASE WHEN pos = {r + 1} THEN f{c} END), 0), 6) AS m{r}_{c}" for r in range(5) for c in range(11))
       + ", CAST(arg_min(src_ip, pkt_no) IN ('10.0.0.1','10.0.3.1') OR arg_min(dst_ip, pkt_no) = '172.16.0.2' AS INT) AS label FROM feat GROUP BY 1, 2", recursive=True))
def sample_matrix_cells(t):
    attackers = t.spark.sql("SELECT * FROM VALUES ('10.0.0.1'), ('10.0.3.1') AS a(ip)")
    victims = t.spark.sql("SELECT * FROM VALUES ('172.16.0.2') AS v(ip)")
    m = O.sample_matrices(O.assign_samples(t.packets, 5, 60.0), 5, attackers, victims)
    return m.select("flow_key", "sample_no", "packets", "label", *[
        F.round(F.get(F.get("matrix", F.lit(r)), F.lit(c)), 6).alias(f"m{r}_{c}") for r in range(5) for c in range(11)])


# --- behaviour --------------------------------------------------------------------------

ORDER = ["timestamp", "flow_no", "flow_line", "dst_port", "src_port", "dst_ip", "protocol", "f_sent", "f_recv", "f_packets"]


def flow_contacts(t):
    """Flow records with their own volumes kept beside the profile inputs."""
    rows = t.flows.withColumns({"f_sent": F.col("bytes_sent"), "f_recv": F.col("bytes_recv"), "f_packets": F.col("packets_sent")})
    return B.as_contacts(rows, F.unix_micros("timestamp") / 1e6, "bytes_sent", F.col("bytes_recv"), F.col("packets_sent"))


_SCORES_SQL = """
 CASE WHEN total_flows >= 5 AND unique_dst_ports > 20 AND unique_dst_ports*1e0/total_flows > 0.5 AND unique_dst_ips*1e0/total_flows < 0.3
  THEN least(1e0, unique_dst_ports/100e0) ELSE 0e0 END AS port_scan_score,
 CASE WHEN last_seen - first_seen >= 1 THEN least(1e0, greatest(
   CASE WHEN packets_sent/(last_seen-first_seen) > 1000 THEN least(1e0, packets_sent/(last_seen-first_seen)/10000) ELSE 0e0 END,
   CASE WHEN bytes_sent/(last_seen-first_seen) > 1e7 THEN least(1e0, bytes_sent/(last_seen-first_seen)/1e8) ELSE 0e0 END)
   * CASE WHEN unique_dst_ips = 1 AND total_flows > 100 THEN 1.5e0 ELSE 1e0 END) ELSE 0e0 END AS ddos_score,
 CASE WHEN total_flows >= 10 AND active_hours >= 20 THEN 0.3e0 ELSE 0e0 END AS c2_score,
 CASE WHEN bytes_sent > 1000000 AND bytes_sent*1e0/greatest(bytes_recv,1) > 10 THEN least(1e0, bytes_sent*1e0/greatest(bytes_recv,1)/100e0) ELSE 0e0 END AS data_exfil_score"""
_PROFILE = """,
agg AS (SELECT src_ip, count(*) AS total_flows, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, CAST(sum(bytes_recv) AS BIGINT) AS bytes_recv,
 CAST(sum(packets_sent) AS BIGINT) AS packets_sent, count(DISTINCT CASE WHEN dst_port<>0 THEN dst_port END) AS unique_dst_ports, count(DISTINCT dst_ip) AS unique_dst_ips,
 count(DISTINCT CASE WHEN src_port<>0 THEN src_port END) AS unique_src_ports, count(DISTINCT hour(timestamp)) AS active_hours,
 count(*) FILTER (protocol=6) AS tcp_flows, count(*) FILTER (protocol=17) AS udp_flows, count(*) FILTER (protocol=1) AS icmp_flows,
 epoch_us(min(timestamp))/1e6 AS first_seen, epoch_us(max(timestamp))/1e6 AS last_seen FROM flows GROUP BY src_ip),
prof AS (SELECT *, """ + _SCORES_SQL + " FROM agg)"
_PCOLS = ["src_ip", "total_flows", "bytes_sent", "bytes_recv", "packets_sent", "unique_dst_ports", "unique_dst_ips", "unique_src_ports",
          "active_hours", "tcp_flows", "udp_flows", "icmp_flows", "first_seen", "last_seen"]
_SCOLS = ["port_scan_score", "ddos_score", "c2_score", "data_exfil_score"]
_MAXS = "greatest(" + ", ".join(_SCOLS) + ")"
_RS = ", ".join(f"round({c}, 6) AS {c}" for c in _SCOLS)


@query("behavior_profiles", "A11 R1 R2 R3 R4 R5 D12", with_views("flows", _PROFILE + f"SELECT {', '.join(_PCOLS)}, {_RS}, round({_MAXS}, 6) AS threat_score FROM prof"))
def behavior_profiles(t):
    return rounded(B.profiles(flow_contacts(t)), *_SCOLS, "threat_score").select(*_PCOLS, *_SCOLS, "threat_score")


@query("suspicious_hosts", "T5", with_views("flows", _PROFILE + f"SELECT src_ip, round({_MAXS}, 6) AS threat_score FROM prof WHERE {_MAXS} >= 0.5"))
def suspicious_hosts(t):
    return rounded(B.suspicious(B.profiles(flow_contacts(t))), "threat_score").select("src_ip", "threat_score")


@query("hourly_activity", "A12", with_views("traffic", "SELECT source_ip AS src_ip, " + ", ".join(
    f"count(*) FILTER (hour(timestamp) = {h}) AS h{h:02d}" for h in range(24)) + " FROM traffic GROUP BY 1"))
def hourly_activity(t):
    rows = t.traffic.select(F.col("source_ip").alias("src_ip"), (F.unix_micros("timestamp") / 1e6).alias("seen_s"))
    return B.hourly_activity(rows).select("src_ip", *[F.get("hourly_activity", F.lit(h)).alias(f"h{h:02d}") for h in range(24)])


_OSQL = "timestamp, flow_no, flow_line, dst_port, src_port, dst_ip, protocol, bytes_sent, bytes_recv, packets_sent"
_RUN = f""",
fo AS (SELECT *, row_number() OVER (ORDER BY {_OSQL}) AS o FROM flows),
f1 AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_port ORDER BY o) = 1 AND dst_port <> 0 AS n1, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY o) = 1 AS n2,
  row_number() OVER (PARTITION BY src_ip, src_port ORDER BY o) = 1 AS n3, row_number() OVER (PARTITION BY src_ip, hour(timestamp) ORDER BY o) = 1 AS n4 FROM fo),
f2 AS (SELECT flow_no, flow_line, timestamp, src_ip, dst_ip, src_port, dst_port, protocol, bytes_sent AS f_sent, bytes_recv AS f_recv, packets_sent AS f_packets,
  count(*) OVER w AS total_flows, CAST(sum(bytes_sent) OVER w AS BIGINT) AS bytes_sent, CAST(sum(bytes_recv) OVER w AS BIGINT) AS bytes_recv, CAST(sum(packets_sent) OVER w AS BIGINT) AS packets_sent,
  CAST(sum(CAST(n1 AS INT)) OVER w AS BIGINT) AS unique_dst_ports, CAST(sum(CAST(n2 AS INT)) OVER w AS BIGINT) AS unique_dst_ips,
  CAST(sum(CAST(n3 AS INT)) OVER w AS BIGINT) AS unique_src_ports, CAST(sum(CAST(n4 AS INT)) OVER w AS BIGINT) AS active_hours,
  CAST(count(*) FILTER (protocol=6) OVER w AS BIGINT) AS tcp_flows, CAST(count(*) FILTER (protocol=17) OVER w AS BIGINT) AS udp_flows, CAST(count(*) FILTER (protocol=1) OVER w AS BIGINT) AS icmp_flows,
  epoch_us(first_value(timestamp) OVER w)/1e6 AS first_seen, epoch_us(timestamp)/1e6 AS last_seen
  FROM f1 WINDOW w AS (PARTITION BY src_ip ORDER BY o ROWS UNBOUNDED PRECEDING)),
running AS (SELECT *, {_SCORES_SQL} FROM f2)"""


def running_rows(t):
    contacts = with_value_block(flow_contacts(t), ["src_ip"], F.col("seen_s"))
    return B.running_profiles(contacts, ORDER)


_RUN_COLS = ["flow_no", "flow_line", "f_sent", *_PCOLS]


@query("running_behavior", "W8", with_views("flows", _RUN + f"SELECT {', '.join(_RUN_COLS)}, {_RS}, round({_MAXS}, 6) AS behavior_score FROM running"))
def running_behavior(t):
    return rounded(running_rows(t), *_SCOLS, "behavior_score").select(*_RUN_COLS, *_SCOLS, "behavior_score")


_LISTS = """,
lists AS (SELECT ip, arg_max(list_name, seq) AS list_name FROM (SELECT * FROM host_lists UNION ALL
 SELECT * FROM (VALUES ('8.8.8.8', CAST(0 AS BIGINT), 'whitelist'), ('8.8.4.4', 0, 'whitelist'), ('1.1.1.1', 0, 'whitelist'), ('208.67.222.222', 0, 'whitelist')) g(ip, seq, list_name)) GROUP BY ip)"""


@query("address_lists", "J4 D13", with_views("host_lists", _LISTS + "SELECT ip, list_name, CASE list_name WHEN 'whitelist' THEN 1e0 ELSE 0e0 END AS score FROM lists"))
def address_lists(t):
    return B.current_lists(t.host_lists).withColumn("score", B.list_score(F.col("list_name")))


_REP = "CASE {s}.list_name WHEN 'whitelist' THEN 1e0 WHEN 'blacklist' THEN 0e0 ELSE 0.5e0 END"


@query("packet_reputation", "J1", with_views("packets host_lists", _LISTS + f"""
SELECT pkt_no, {_REP.format(s='s')} AS src_reputation, {_REP.format(s='d')} AS dst_reputation, coalesce(s.list_name,'unknown') AS src_reputation_source, coalesce(d.list_name,'unknown') AS dst_reputation_source
FROM packets LEFT JOIN lists s ON s.ip = src_ip LEFT JOIN lists d ON d.ip = dst_ip"""))
def packet_reputation(t):
    rows = B.with_reputation(t.packets, B.current_lists(t.host_lists))
    return rows.select("pkt_no", "src_reputation", "dst_reputation", "src_reputation_source", "dst_reputation_source")


@query("malicious_packets", "J2", with_views("packets host_lists", _LISTS + f"""
SELECT pkt_no, src_ip, dst_ip, round(1 - {_REP.format(s='s')}, 6) AS threat_score FROM packets LEFT JOIN lists s ON s.ip = src_ip WHERE {_REP.format(s='s')} < 0.3"""))
def malicious_packets(t):
    rows = B.with_reputation(t.packets, B.current_lists(t.host_lists), sides=("src",))
    return rows.where(B.is_malicious(F.col("src_reputation"))).select(
        "pkt_no", "src_ip", "dst_ip", F.round(1 - F.col("src_reputation"), 6).alias("threat_score"))


_VERD = _RUN + _LISTS + f""",
rv AS (SELECT r.*, {_REP.format(s='s')} AS sr, {_REP.format(s='d')} AS dr FROM running r LEFT JOIN lists s ON s.ip = src_ip LEFT JOIN lists d ON d.ip = dst_ip),
vd AS (SELECT *, coalesce(greatest(CASE WHEN sr < 0.3 THEN 1 - sr END, CASE WHEN dr < 0.3 THEN 1 - dr END,
  CASE WHEN port_scan_score > 0.3 THEN port_scan_score END, CASE WHEN ddos_score > 0.3 THEN ddos_score END, CASE WHEN c2_score > 0.3 THEN c2_score END, CASE WHEN data_exfil_score > 0.3 THEN data_exfil_score END), 0) AS threat_score,
  concat_ws(',', CASE WHEN c2_score > 0.3 THEN 'c2' END, CASE WHEN data_exfil_score > 0.3 THEN 'data_exfil' END, CASE WHEN ddos_score > 0.3 THEN 'ddos' END,
   CASE WHEN port_scan_score > 0.3 THEN 'port_scan' END, CASE WHEN sr < 0.3 OR dr < 0.3 THEN 'unknown' END) AS threat_types FROM rv)"""


def verdict_rows(t):
    return B.verdicts(B.with_reputation(running_rows(t), B.current_lists(t.host_lists)))


@query("flow_verdicts", "R6 U4", with_views("flows host_lists", _VERD + """
SELECT flow_no, flow_line, f_sent, src_ip, dst_ip, round(threat_score, 6) AS threat_score, threat_types, threat_score >= 0.5 AS is_threat FROM vd"""))
def flow_verdicts(t):
    return verdict_rows(t).select("flow_no", "flow_line", "f_sent", "src_ip", "dst_ip", F.round("threat_score", 6).alias("threat_score"),
                                  F.concat_ws(",", "threat_types").alias("threat_types"), "is_threat")


_REPORTS = _VERD + """,
rp AS (SELECT src_ip AS ip, CASE WHEN contains(threat_types,'ddos') THEN 'botnet' WHEN contains(threat_types,'port_scan') THEN 'scanner' ELSE 'unknown' END AS category, threat_score AS confidence FROM vd WHERE threat_score > 0.7),
rs AS (SELECT ip, sum(confidence) AS c, count(*) AS reports, list(DISTINCT category) AS cats FROM rp GROUP BY ip),
rep AS (SELECT coalesce(rs.ip, l.ip) AS ip, greatest(0, CASE l.list_name WHEN 'whitelist' THEN 1e0 WHEN 'blacklist' THEN 0e0 ELSE 0.5e0 END - 0.2*coalesce(c,0)) AS score,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(cats, []), CASE WHEN l.list_name = 'blacklist' THEN ['unknown'] ELSE [] END))), ',') AS categories,
  coalesce(reports, 0) AS reports, coalesce(l.list_name, 'unknown') AS source FROM rs FULL JOIN lists l ON l.ip = rs.ip)"""


@query("reputation_after_reports", "J3 R7", with_views("flows host_lists", _REPORTS + "SELECT ip, round(score, 6) AS score, categories, reports, source, score < 0.3 AS is_malicious FROM rep"))
def reputation_after_reports(t):
    out = B.apply_reports(B.current_lists(t.host_lists), B.reports_from(verdict_rows(t)))
    return rounded(out, "score").withColumn("categories", F.concat_ws(",", "categories"))


@query("reputation_statistics", "A24", with_views("flows host_lists", _REPORTS + """SELECT count(*) AS total_ips, count(*) FILTER (score < 0.3) AS malicious_ips,
 count(*) FILTER (source='blacklist') AS blacklist_size, count(*) FILTER (source='whitelist') AS whitelist_size, CAST(sum(reports) AS BIGINT) AS total_reports FROM rep"""))
def reputation_statistics(t):
    return B.reputation_statistics(B.apply_reports(B.current_lists(t.host_lists), B.reports_from(verdict_rows(t))))


@query("detector_statistics", "A23", with_views("flows host_lists", _VERD + """,
ty AS (SELECT unnest(string_split(threat_types, ',')) AS threat_type FROM vd WHERE threat_score >= 0.5),
tot AS (SELECT count(*) AS total, count(*) FILTER (threat_score >= 0.5) AS threats FROM vd)
SELECT threat_type, count(*) AS cnt, any_value(total) AS total, any_value(threats) AS threats, round(any_value(threats)*1e0/any_value(total), 6) AS threat_rate FROM ty, tot GROUP BY 1
UNION ALL SELECT NULL, 0, total, threats, round(threats*1e0/greatest(total, 1), 6) FROM tot WHERE threats = 0"""))
def detector_statistics(t):
    return rounded(B.detector_statistics(verdict_rows(t)), "threat_rate")
