"""The analytic views as SQL text for the second engine."""

from __future__ import annotations

from tidewatch.schemas import PHISHING_FEATURES

_HOST = "concat('10.', CAST(CAST(floor(e.user_id / 250) AS INT) AS VARCHAR), '.', CAST(e.user_id % 250 AS VARCHAR), '.1')"

VIEWS: dict[str, str] = {}

VIEWS["traffic"] = f"""
t_a AS (SELECT e.*, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) AS k FROM events e),
t_b AS (SELECT t_a.*, CASE WHEN event_type IN ('view','click','purchase') THEN 'benign' WHEN event_type='signup' THEN 'phishing'
   ELSE CASE k % 4 WHEN 0 THEN 'dos' WHEN 1 THEN 'ddos' WHEN 2 THEN 'probe' ELSE 'brute_force' END END AS threat_type,
   LEAST(value / 100.0, 1.0) AS risk_score FROM t_a),
t_c AS (SELECT t_b.*, CASE WHEN threat_type='benign' THEN 'safe' WHEN risk_score>=0.85 THEN 'critical' WHEN risk_score>=0.7 THEN 'high' WHEN risk_score>=0.5 THEN 'medium' ELSE 'low' END AS risk_level FROM t_b),
traffic AS (SELECT e.event_id AS id, e.ts AS timestamp, {_HOST} AS source_ip,
 concat('172.16.0.', CAST(e.k % 5 + 1 AS VARCHAR)) AS dest_ip,
 CASE e.k % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 3306 END AS dest_port,
 e.threat_type, e.risk_level, e.risk_score,
 CASE WHEN e.threat_type='benign' THEN CASE WHEN e.k % 10 < 8 THEN 'allow' ELSE 'log' END
      WHEN e.risk_level='critical' THEN 'block' WHEN e.risk_level='high' THEN 'challenge' ELSE 'alert' END AS action,
 e.value / 10.0 AS processing_time_ms,
 CASE WHEN e.user_id % 7 = 0 THEN NULL ELSE n.n_name END AS geo_country
FROM t_c e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25)"""

VIEWS["packets"] = f"""
p_a AS (SELECT e.*, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) AS k, {_HOST} AS a_ip FROM events e),
p_b AS (SELECT p_a.*, concat('172.16.0.', CAST(k % 3 + 1 AS VARCHAR)) AS z_ip, 40000 + CAST(user_id % 3 AS INT) AS a_port,
  CASE k % 2 WHEN 0 THEN 80 ELSE 443 END AS z_port FROM p_a),
packets AS (SELECT event_id AS pkt_no, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 1e10 AS ts_s,
 CASE WHEN k % 5 = 0 THEN z_ip ELSE a_ip END AS src_ip, CASE WHEN k % 5 = 0 THEN a_ip ELSE z_ip END AS dst_ip,
 CASE WHEN k % 5 = 0 THEN z_port ELSE a_port END AS src_port, CASE WHEN k % 5 = 0 THEN a_port ELSE z_port END AS dst_port,
 CASE WHEN user_id % 10 = 0 THEN 17 ELSE 6 END AS protocol,
 40 + CAST(floor(value * 3) AS INT) AS packet_size,
 CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 24 WHEN 'error' THEN CASE k % 10 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 16 END ELSE 16 END AS tcp_flags
FROM p_b)"""

VIEWS["keyed"] = """
keyed AS (SELECT p.*, CASE WHEN src_ip > dst_ip OR (src_ip = dst_ip AND src_port > dst_port)
   THEN concat(dst_ip, ':', CAST(dst_port AS VARCHAR), '-', src_ip, ':', CAST(src_port AS VARCHAR), '-', CAST(protocol AS VARCHAR))
   ELSE concat(src_ip, ':', CAST(src_port AS VARCHAR), '-', dst_ip, ':', CAST(dst_port AS VARCHAR), '-', CAST(protocol AS VARCHAR)) END AS flow_key
 FROM packets p)"""

VIEWS["flows"] = """
flows AS (SELECT l_orderkey AS flow_no, l_linenumber AS flow_line, l_shipdate AS timestamp,
 concat('10.1.', CAST(CAST(floor(l_suppkey / 250) AS INT) AS VARCHAR), '.', CAST(l_suppkey % 250 AS VARCHAR)) AS src_ip,
 concat('172.16.1.', CAST(l_partkey % 10 AS VARCHAR)) AS dst_ip,
 CAST(40000 + l_orderkey % 1000 AS INT) AS src_port,
 CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 1000 ELSE 443 END AS INT) AS dst_port,
 CASE l_returnflag WHEN 'A' THEN 17 WHEN 'R' THEN 1 ELSE 6 END AS protocol,
 CAST(floor(l_extendedprice) AS BIGINT) AS bytes_sent,
 CAST(floor(l_extendedprice * CASE WHEN l_suppkey % 5 = 0 THEN 0.01e0 ELSE 0.5e0 END) AS BIGINT) AS bytes_recv,
 CAST(l_quantity AS BIGINT) AS packets_sent
FROM lineitem)"""

_CELL = ["((event_id*%d + user_id*%d + CAST(floor(value) AS INT)) %% 3 - 1)" % (j + 3, j * j + 1) for j in range(3)]
VIEWS["phishing"] = "phishing AS (SELECT event_id AS row_id, " + ", ".join(
    f"CASE WHEN (event_id + {j}) % 17 <> 0 THEN CAST((event_id*{j + 3} + user_id*{j * j + 1} + CAST(floor(value) AS INT)) % 3 - 1 AS INT) END AS \"{c}\""
    for j, c in enumerate(PHISHING_FEATURES)
) + f", CASE WHEN {_CELL[0]} * {_CELL[1]} + {_CELL[2]} + (event_id*31 + user_id*17) % 5 - 2 >= 0 THEN 1 ELSE -1 END AS \"Result\" FROM events)"

VIEWS["rich_pages"] = """
rich_pages AS (SELECT page_id, url, replace(html, '</body>', concat(
 CASE page_id % 4 WHEN 0 THEN '<form action="/login" method="post"><input type="text" name="u" placeholder="User"><input type="password" name="p"></form>'
  WHEN 1 THEN '<form action="https://collect.example.biz/x"><input name="q"></form>'
  WHEN 2 THEN '<form action=""><input type="email" name="m"></form><a href="mailto:a@b.example">m</a>' ELSE '' END,
 CASE page_id % 3 WHEN 0 THEN '<img src="https://cdn.other.example/i.png"><img src="/l.png"><iframe src="/f"></iframe>'
  WHEN 1 THEN '<link rel="shortcut icon" href="/favicon.ico"><script src="https://js.other.example/a.js"></script>'
  ELSE '<link rel="icon" href="https://static.other.example/f.ico"><a href="#">top</a><a href="javascript:void(0)">x</a>' END,
 CASE page_id % 5 WHEN 0 THEN '<div onMouseOver="x()">h</div><a href="https://partner.example/p">p</a>'
  WHEN 1 THEN '<p oncontextmenu="return false">r</p><script>window.open(''a'')</script>'
  WHEN 2 THEN '<meta name="description" content="About  page &amp; more">'
  ELSE '<a href=''http://far.example.org/q?a=1&amp;b=2''>f</a>' END,
 '</body>')) AS html FROM pages)"""

VIEWS["urls"] = """
u_a AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]*)', 1) AS d FROM pages),
urls AS (SELECT page_id AS url_id, url FROM u_a UNION ALL
 SELECT page_id, CASE page_id % 8
  WHEN 0 THEN concat('http://192.168.', CAST(page_id % 200 AS VARCHAR), '.7/a')
  WHEN 1 THEN concat('  ', d, ':8080/x ')
  WHEN 2 THEN concat('http://user@', d, ':443/y')
  WHEN 3 THEN concat('https://bit.ly/', CAST(page_id AS VARCHAR), '//r')
  WHEN 4 THEN concat('http://secure-https.', d, '/', repeat('a', CAST(page_id % 60 AS INT)))
  WHEN 5 THEN concat('http://my-bank.com/?u=', url)
  WHEN 6 THEN concat('http://0x7f000001/', CAST(page_id AS VARCHAR))
  ELSE concat('a.b.', d) END FROM u_a)"""

VIEWS["domain_facts"] = """
domain_facts AS (SELECT domain, length(domain) % 4 <> 0 AS dns_ok,
  CASE length(domain) % 3 WHEN 0 THEN TIMESTAMP '2023-01-01' WHEN 1 THEN TIMESTAMP '2030-01-01' END AS not_after,
  CASE WHEN length(domain) % 2 = 0 THEN 'DigiCert Inc' ELSE 'Example Org' END AS issuer_org,
  CASE WHEN length(domain) % 5 <> 0 THEN DATE '2024-06-01' - CAST(length(domain) * 13 AS INT) END AS created,
  CASE WHEN length(domain) % 5 <> 1 THEN DATE '2024-06-01' + CAST(length(domain) * 17 - 150 AS INT) END AS expires,
  CASE WHEN length(domain) % 6 = 0 THEN 'registrar.example' WHEN length(domain) % 6 <> 1 THEN domain END AS whois_domain,
  CASE WHEN length(domain) % 6 <> 1 THEN CAST(length(domain) % 5 AS INT) END AS redirects,
  length(domain) % 6 <> 1 AS whois_ok
 FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]*)', 1) AS domain FROM pages) WHERE length(domain) % 7 <> 0)"""

VIEWS["host_lists"] = f"""
hosts AS (SELECT DISTINCT user_id AS no, {_HOST} AS ip FROM events e UNION ALL
  SELECT s_suppkey, concat('10.1.', CAST(CAST(floor(s_suppkey / 250) AS INT) AS VARCHAR), '.', CAST(s_suppkey % 250 AS VARCHAR)) FROM supplier),
host_lists AS (SELECT ip, CAST(1 AS BIGINT) AS seq, CASE WHEN no % 11 = 0 THEN 'whitelist' ELSE 'blacklist' END AS list_name
  FROM hosts WHERE no % 11 < 3
 UNION ALL SELECT ip, CAST(2 AS BIGINT), 'whitelist' FROM hosts WHERE no % 33 = 1)"""

VIEWS["predictions"] = """
predictions AS (SELECT id, CAST(threat_type <> 'benign' AS INT) AS y_true, CAST(risk_score >= 0.5 AS INT) AS y_pred, risk_score AS score FROM traffic)"""

VIEWS["decisions"] = """
decisions AS (SELECT id AS seq, CASE action WHEN 'allow' THEN 0 WHEN 'block' THEN 1 WHEN 'alert' THEN 2 WHEN 'log' THEN 3 ELSE 4 END AS action,
  threat_type <> 'benign' AS is_attack, risk_score AS threat_score FROM traffic)"""

VIEWS["model_scores"] = """
model_scores AS (SELECT id, CASE WHEN id % 5 <> 0 THEN risk_score END AS statistical,
  CASE WHEN id % 3 <> 0 THEN (id * 7 % 101) / 100e0 END AS text,
  CASE WHEN id % 4 = 1 THEN (id * 13 % 97) / 96e0 END AS visual FROM traffic)"""


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named views (in the given order), then ``body``.

    ``body`` may continue the list with further CTEs by starting with a comma.
    """
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(VIEWS[n] for n in names.split()) + "\n" + body
