"""Known answers on small inline tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import html as H
from tidewatch.functions import url as U
from tidewatch.functions import vectors as V
from tidewatch.operators import behavior as B
from tidewatch.operators import flows as O
from tidewatch.operators import incstats as I
from tidewatch.operators import pages as P
from tidewatch.operators import policy as R
from tidewatch.operators import quality as Q
from tidewatch.operators import traffic as T
from tidewatch.schemas import PHISHING_FEATURES

NOW = dt.datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("192.168.1.1", "benign", "allow", 0.10, None), ("192.168.1.2", "benign", "allow", 0.15, None),
        ("192.168.1.1", "benign", "allow", 0.20, None), ("10.0.0.1", "phishing", "block", 0.85, "Russia"),
        ("10.0.0.2", "phishing", "block", 0.90, "China"), ("10.0.0.1", "dos", "block", 0.95, "Russia"),
        ("172.16.0.1", "unknown", "challenge", 0.50, None)]
    return spark.createDataFrame(
        [(i, NOW, ip, threat, "safe", score, action, 1.0, geo) for i, (ip, threat, action, score, geo) in enumerate(rows)],
        "id long, timestamp timestamp, source_ip string, threat_type string, risk_level string, risk_score double, action string, processing_time_ms double, geo_country string")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_counters(log):
    row = T.action_counters(log).first()
    assert (row.total_requests, row.blocked_requests, row.allowed_requests, row.challenged_requests) == (7, 3, 3, 1)
    assert row.avg_risk_score == pytest.approx(3.65 / 7)


def test_empty_log_gives_zeros(log):
    row = T.overview(log.where("id < 0")).first()
    assert (row.total_requests, row.avg_risk_score, row.top_source_ips) == (0, 0.0, "")


def test_distributions(log):
    assert as_dict(T.distribution(log, "threat_type")) == {"benign": 3, "phishing": 2, "dos": 1, "unknown": 1}
    assert as_dict(T.distribution(log, "action")) == {"allow": 3, "block": 3, "challenge": 1}
    assert as_dict(T.distribution(log, "geo_country", "Unknown")) == {"Russia": 2, "China": 1, "Unknown": 4}
    assert "192.168.1.1" in as_dict(T.top_sources(log))
    assert "192.168.1.1" not in as_dict(T.top_sources(log, threat_only=True))


def test_histogram_keeps_empty_bins_and_closes_the_top(spark, log):
    bins = T.risk_histogram(log).collect()
    assert len(bins) == 10 and all(b.low < b.high for b in bins) and sum(b.cnt for b in bins) == 7
    top = spark.createDataFrame([(1.0,), (0.3,)], "risk_score double")
    assert {r.bin: r.cnt for r in T.risk_histogram(top).collect() if r.cnt} == {9: 1, 2: 1}
    assert sum(r.cnt for r in T.risk_histogram(top, compat=True).collect()) == 1


def test_timeline(spark, log):
    start = NOW - dt.timedelta(hours=3)
    hours = spark.createDataFrame([(NOW - dt.timedelta(hours=h),) for h in (2, 1, 1, 0)], "timestamp timestamp")
    rows = hours.select("timestamp", F.lit("allow").alias("action"), F.lit("benign").alias("threat_type"))
    got = {(r.bucket_start - start).seconds // 3600: r.total for r in T.timeline(rows, start).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_paging_and_bounds(log):
    assert [r.risk_score for r in T.ordered(log, "risk_score").limit(2).collect()] == [0.95, 0.9]
    page = T.page(log, limit=3, offset=5).collect()
    assert len(page) == 2 and page[0].total == 7
    assert T.ordered(log, "no_such_column").first().id == 0
    for bad in (lambda: T.last_hours(log, NOW, 0), lambda: T.risk_histogram(log, 4), lambda: T.timeline(log, NOW, 1), lambda: T.page(log, 5000)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("url", "feature", "value"), [
    ("http://192.168.1.1/path", "having_IP_Address", -1), ("http://0x7f000001/path", "having_IP_Address", -1),
    ("http://example.com/path", "having_IP_Address", 1), ("http://a.com", "URL_Length", 1),
    ("http://example.com/" + "a" * 50, "URL_Length", 0), ("http://example.com/" + "a" * 100, "URL_Length", -1),
    ("http://bit.ly/abc123", "Shortining_Service", -1), ("http://tinyurl.com/xyz", "Shortining_Service", -1),
    ("http://example.com", "Shortining_Service", 1), ("http://user@example.com", "having_At_Symbol", -1),
    ("http://example.com//redirect", "double_slash_redirecting", -1), ("http://example.com/path", "double_slash_redirecting", 1),
    ("http://fake-bank.com", "Prefix_Suffix", -1), ("http://example.com", "Prefix_Suffix", 1),
    ("http://www.example.com", "having_Sub_Domain", 1), ("http://sub.example.com", "having_Sub_Domain", 0),
    ("http://a.b.c.example.com", "having_Sub_Domain", -1), ("http://https-secure.example.com", "HTTPS_token", -1),
    ("http://example.com:80/", "port", 1), ("http://example.com:8888/", "port", -1), ("http://example.com/", "port", 1),
    ("http://google.com", "web_traffic", 1), ("http://example.xyz", "web_traffic", -1), ("example.com", "port", 1),
])
def test_url_feature(spark, url, feature, value):
    row = P.url_structure(spark.createDataFrame([(url,)], "url string")).first()
    assert row[feature] == value


def test_shortener_in_longer_name(spark):
    urls = spark.createDataFrame([("http://microsoft.com",)], "url string")
    assert P.url_structure(urls).first().Shortining_Service == -1
    assert P.url_structure(urls, strict_shorteners=True).first().Shortining_Service == 1


FACTS = "domain string, dns_ok boolean, not_after timestamp_ntz, issuer_org string, created date, expires date, whois_domain string, redirects int, whois_ok boolean"


def test_thirty_features_without_page_or_facts(spark):
    pages = spark.createDataFrame([(1, "http://example.com", None)], "page_id long, url string, html string")
    row = P.phishing_features(pages, spark.createDataFrame([], FACTS), NOW).first().asDict()
    assert [c for c in row if c in PHISHING_FEATURES] == PHISHING_FEATURES
    assert (row["Iframe"], row["on_mouseover"], row["Favicon"], row["SSLfinal_State"], row["Redirect"]) == (1, 1, -1, -1, -1)


LOGIN = """<html><head><title>  Sign   in </title><script>var a = "<a href='x'>";</script></head><body><h1>Welcome</h1><p>Please log in.</p>
<form action="/login" method="post"><input type="text" name="u"><input type="password" name="p" placeholder="secret"><input name="go"></form>
<iframe src="x"></iframe><a href="mailto:a@b.c">m</a></body></html>"""


def test_page_content(spark):
    pages = spark.createDataFrame([(1, "http://example.com", LOGIN)], "page_id long, url string, html string")
    row = H.page_content(pages).first()
    assert row.title == "Sign in" and "Welcome" in row.text and "var a" not in row.text
    assert len(row.forms) == 1 and row.forms[0].action == "/login" and row.forms[0].method == "POST"
    assert [i.type for i in row.forms[0].inputs] == ["text", "password", "text"]
    assert row.has_password_field and row.has_login_form and row.links.total == 0
    parsed = pages.select(H.tag_names(H.markup(F.col("html"))).alias("t")).first().t
    assert parsed.count("input") == 3 and parsed.count("a") == 1


TEXTS = [("A&copy;B &#x27;q&#x27;", "A\u00a9B 'q'"), ("caf&eacute; &amp;amp; &lt;b&gt;", "caf\u00e9 &amp; <b>"), ("a & b &unknown; &#8364;&#128512;", "a & b &unknown; \u20ac\U0001f600"),
         ("&#0;&#xD800;&amp", "\ufffd\ufffd&"), ("", ""), (None, None)]


def test_character_references(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(TEXTS)], "id int, t string").select("id", H.unescape(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [b for _, b in TEXTS]


def test_nested_hidden_elements(spark):
    pages = [(1, "<body>a<nav>x<nav>y</nav>z</nav>b<ASIDE class='k'>q</aside>c<navy>d</navy></body>"), (2, "<body>a<nav>open</body>"), (3, None), (4, "<body><header>h</header>t</nav>u</body>")]
    rows = spark.createDataFrame(pages, "id int, h string").select("id", H.visible_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ["a b c d", "a open", None, "t u"]


def test_clean_text(spark):
    assert spark.range(1).select(H.tidy(F.lit("  Hello   World  \n\n  Test  "))).first()[0] == "Hello World Test"


def packets(spark, rows):
    return spark.createDataFrame(
        [(i, float(t), a, b, 1000, 80, 6, size, flags) for i, (t, a, b, size, flags) in enumerate(rows)],
        "pkt_no long, ts_s double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packet_size int, tcp_flags int")


def test_idle_gap_of_exactly_the_limit_keeps_the_flow(spark):
    rows = packets(spark, [(0, "a", "b", 10, 16), (60, "a", "b", 10, 16), (120.5, "a", "b", 10, 1), (121, "a", "b", 10, 16)])
    flows = O.flow_table(rows).orderBy("flow_seq").collect()
    assert [f.packets_sent for f in flows] == [2, 1, 1] and flows[1].duration == 0 and flows[1].bytes_per_second == 0


def test_samples_of_twenty_packets(spark):
    rows = packets(spark, [(1 + i * 0.1, "a", "b", 100, 16) for i in range(20)])
    m = O.sample_matrices(O.assign_samples(rows, 5, 10.0), 5).collect()
    assert len(m) == 4 and all(len(r.matrix) == 5 and len(r.matrix[0]) == 11 for r in m)


def test_one_packet_vector(spark):
    v = I.packet_vectors(packets(spark, [(1.0, "a", "b", 1024, 0)])).first().vector
    assert len(v) == 115
    for c in range(5):
        for s in range(5):
            assert v[c * 23 + 3 * s : c * 23 + 3 * s + 3] == [1.0, 1024.0, 0.0]


def test_damped_mean(spark):
    rows = I.channel_rows(packets(spark, [(t, "a", "b", x, 0) for t, x in ((1, 10), (2, 20), (3, 30))]), ["ip"])
    row = I.damped_statistics(rows, [1.0]).orderBy(F.desc("pkt_no")).first()
    w = 1 + math.exp(-1) + math.exp(-2)
    assert row.weight_0 == pytest.approx(w) and row.mean_0 == pytest.approx((30 + 20 * math.exp(-1) + 10 * math.exp(-2)) / w)


def test_port_scan(spark):
    rows = spark.createDataFrame([("s", f"10.0.0.{i % 10}", 5000, i + 1, 6, 100, float(i)) for i in range(100)],
                                 "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packet_size int, ts double")
    assert B.profiles(B.as_contacts(rows, F.col("ts"), "packet_size")).first().port_scan_score == 1.0


def test_lists(spark):
    changes = spark.createDataFrame([("1.2.3.4", 1, "blacklist"), ("5.6.7.8", 1, "blacklist"), ("5.6.7.8", 2, "whitelist")], "ip string, seq long, list_name string")
    lists = {r.ip: r.list_name for r in B.current_lists(changes).collect()}
    assert lists["8.8.8.8"] == "whitelist" and lists["1.2.3.4"] == "blacklist" and lists["5.6.7.8"] == "whitelist"


@pytest.mark.parametrize(("score", "level", "response", "threat"), [
    (0.1, "safe", "allow", False), (0.3, "safe", "allow", True), (0.9, "high", "challenge", True), (0.98, "critical", "block", True)])
def test_confidence(spark, score, level, response, threat):
    row = R.detect(spark.createDataFrame([(score,)], "s double"), "s", "m").first()
    assert (row.threat_level, row.response, row.is_threat) == (level, response, threat)


def test_best_action_and_rewards(spark):
    one = spark.range(1)
    got = [one.select(R.best_action(F.lit(x))).first()[0] for x in (0.9, 0.6, 0.1)]
    assert got == ["BLOCK", "CHALLENGE", "ALLOW"]
    rows = spark.createDataFrame([(0, 1, True, 0.8), (1, 1, False, 0.2)], "seq long, action int, is_attack boolean, threat_score double")
    assert [r.reward for r in R.shaped_rewards(rows).orderBy("seq").collect()] == [15.0, -8.0]
    assert [r.reward for r in R.with_reward(rows, "basic").orderBy("seq").collect()] == [10.0, -8.0]


def test_fusion_without_scores(spark):
    row = R.fuse(spark.createDataFrame([(None, None, None)], "statistical double, text double, visual double")).first()
    assert (row.fused_score, row.n_models, row.is_phishing) == (0.5, 0, True)
    assert sum(R.normalized({"a": 0.5, "b": 0.3, "c": 0.2}).values()) == pytest.approx(1)


def test_validation_of_incomplete_table(spark):
    ten = spark.createDataFrame([tuple([1] * 10)] * 5, ", ".join(f"{c} int" for c in PHISHING_FEATURES[:10]))
    report = Q.validation_report(ten, PHISHING_FEATURES)
    assert report.where("status = 'missing'").count() == 20 and not Q.is_valid(report).first().is_valid
    filled, changed = Q.impute_report(ten, PHISHING_FEATURES)
    assert filled.columns == PHISHING_FEATURES and changed.count() == 20


def test_missing_column_and_null_together(spark):
    nine = spark.createDataFrame([(1, None), (3, 4)], "URL_Length int, port int")
    for strategy in ("mean", "median", "most_frequent", "constant", "knn"):
        filled, _ = Q.impute_report(nine, PHISHING_FEATURES, strategy)
        assert filled.where("port IS NULL").count() == 0


def test_drift_policy(spark):
    a = spark.range(200).select(F.col("id").cast("double").alias("x"))
    report = Q.drift_report(a, a.select((F.col("x") + 500).alias("x")), ["x"])
    assert not Q.check_drift(report)
    with pytest.raises(ValueError):
        Q.check_drift(report, "fail")
    assert Q.check_drift(Q.drift_report(a, a, ["x"]), "fail")


def test_formats():
    assert V.input_format(["duration", "src_bytes"]) == "nslkdd"
    assert V.input_format(["src_ip", "dst_ip"]) == "raw_packet"
    assert V.input_format(["src_ip", "dst_ip", "bytes_sent"]) == "flow"
    assert V.input_format(["x"]) == "feature_vector"


def test_parse_bad_urls(spark):
    rows = spark.createDataFrame([("",), ("http://",), ("http://h:port/x",), ("ftp://a/b",)], "url string")
    assert U.parse(rows).count() == 4 and P.url_structure(rows).count() == 4
