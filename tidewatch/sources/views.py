"""Analytic views over the star-schema tables.

The tables hold events, line items and pages; these views read them as traffic logs,
packets, flows, feature rows and verdicts. Each view is a projection of its table, so
filters and column pruning still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import PHISHING_FEATURES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _props_number() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def _event_host() -> Column:
    net = F.floor(F.col("user_id") / 250).cast("int").cast("string")
    return F.concat(F.lit("10."), net, F.lit("."), (F.col("user_id") % 250).cast("string"), F.lit(".1"))


def traffic(events: DataFrame, nation: DataFrame) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    threat = (
        F.when(kind.isin("view", "click", "purchase"), "benign")
        .when(kind == "signup", "phishing")
        .when(k % 4 == 0, "dos").when(k % 4 == 1, "ddos").when(k % 4 == 2, "probe")
        .otherwise("brute_force")
    )
    score = F.col("risk_score")
    level = (
        F.when(F.col("threat_type") == "benign", "safe")
        .when(score >= 0.85, "critical").when(score >= 0.7, "high")
        .when(score >= 0.5, "medium").otherwise("low")
    )
    action = (
        F.when((F.col("threat_type") == "benign") & (k % 10 < 8), "allow")
        .when(F.col("threat_type") == "benign", "log")
        .when(F.col("risk_level") == "critical", "block")
        .when(F.col("risk_level") == "high", "challenge").otherwise("alert")
    )
    port = F.when(k % 4 == 0, 80).when(k % 4 == 1, 443).when(k % 4 == 2, 22).otherwise(3306)
    rows = (
        events.withColumn("k", _props_number())
        .withColumn("threat_type", threat)
        .withColumn("risk_score", F.least(F.col("value") / 100.0, F.lit(1.0)))
        .withColumn("risk_level", level)
        .withColumn("action", action)
        .withColumn("nation_no", (F.col("user_id") % 25).cast("int"))
    )
    # nation is a dimension; the optimizer broadcasts it from its file size.
    return rows.join(nation, rows.nation_no == nation.n_nationkey, "left").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        _event_host().alias("source_ip"),
        F.concat(F.lit("172.16.0."), (k % 5 + 1).cast("string")).alias("dest_ip"),
        port.alias("dest_port"),
        "threat_type", "risk_level", "risk_score", "action",
        (F.col("value") / 10.0).alias("processing_time_ms"),
        F.when(F.col("user_id") % 7 != 0, F.col("n_name")).alias("geo_country"),
    )


def packets(events: DataFrame) -> DataFrame:
    """Packets in arrival order: ``pkt_no`` is the arrival ordinal, time runs 10,000 x faster."""
    k, kind = F.col("k"), F.col("event_type")
    reverse = k % 5 == 0
    a_ip, z_ip = _event_host(), F.concat(F.lit("172.16.0."), (k % 3 + 1).cast("string"))
    a_port = (F.lit(40000) + (F.col("user_id") % 3).cast("int"))
    z_port = F.when(k % 2 == 0, 80).otherwise(443)
    flags = (
        F.when(kind == "signup", 2).when(kind == "view", 24)
        .when((kind == "error") & (k % 10 == 0), 4).when((kind == "error") & (k % 10 == 1), 1)
        .otherwise(16)
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    return events.withColumn("k", _props_number()).select(
        F.col("event_id").alias("pkt_no"),
        (micros.cast("double") / 1e10).alias("ts_s"),
        F.when(reverse, z_ip).otherwise(a_ip).alias("src_ip"),
        F.when(reverse, a_ip).otherwise(z_ip).alias("dst_ip"),
        F.when(reverse, z_port).otherwise(a_port).alias("src_port"),
        F.when(reverse, a_port).otherwise(z_port).alias("dst_port"),
        F.when(F.col("user_id") % 10 == 0, 17).otherwise(6).alias("protocol"),
        (F.lit(40) + F.floor(F.col("value") * 3).cast("int")).alias("packet_size"),
        flags.alias("tcp_flags"),
    )


def flows(lineitem: DataFrame) -> DataFrame:
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    back = F.when(supp % 5 == 0, 0.01).otherwise(0.5)
    return lineitem.select(
        F.col("l_orderkey").alias("flow_no"),
        F.col("l_linenumber").alias("flow_line"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("10.1."), F.floor(supp / 250).cast("int").cast("string"), F.lit("."),
                 (supp % 250).cast("string")).alias("src_ip"),
        F.concat(F.lit("172.16.1."), (part % 10).cast("string")).alias("dst_ip"),
        (F.lit(40000) + F.col("l_orderkey") % 1000).cast("int").alias("src_port"),
        F.when(supp % 2 == 0, part % 1000).otherwise(443).cast("int").alias("dst_port"),
        F.when(F.col("l_returnflag") == "A", 17).when(F.col("l_returnflag") == "R", 1)
        .otherwise(6).alias("protocol"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes_sent"),
        F.floor(F.col("l_extendedprice") * back).cast("bigint").alias("bytes_recv"),
        F.col("l_quantity").cast("bigint").alias("packets_sent"),
    )


def phishing(events: DataFrame) -> DataFrame:
    """30 features in -1/0/1 with nulls, and a target in -1/1, one row per event.

    The target follows the product of two features and a third, with noise that no feature
    holds: no single feature gives it away and no model can be right about every row.
    """
    whole = F.floor("value").cast("int")
    cols, plain = [], []
    for j, name in enumerate(PHISHING_FEATURES):
        raw = (F.col("event_id") * (j + 3) + F.col("user_id") * (j * j + 1) + whole) % 3 - 1
        plain.append(raw)
        cols.append(F.when((F.col("event_id") + j) % 17 != 0, raw.cast("int")).alias(name))
    target = plain[0] * plain[1] + plain[2] + (F.col("event_id") * 31 + F.col("user_id") * 17) % 5 - 2
    return events.select(
        F.col("event_id").alias("row_id"), *cols,
        F.when(target >= 0, 1).otherwise(-1).alias("Result"),
    )


def rich_pages(pages: DataFrame) -> DataFrame:
    """Pages with forms, images, frames and links added by page number.

    The raw pages carry none of these, so the markup rules would otherwise see one branch.
    """
    n = F.col("page_id")
    extra = F.concat(
        F.when(n % 4 == 0, F.lit('<form action="/login" method="post"><input type="text" name="u" placeholder="User"><input type="password" name="p"></form>'))
        .when(n % 4 == 1, F.lit('<form action="https://collect.example.biz/x"><input name="q"></form>'))
        .when(n % 4 == 2, F.lit('<form action=""><input type="email" name="m"></form><a href="mailto:a@b.example">m</a>'))
        .otherwise(F.lit("")),
        F.when(n % 3 == 0, F.lit('<img src="https://cdn.other.example/i.png"><img src="/l.png"><iframe src="/f"></iframe>'))
        .when(n % 3 == 1, F.lit('<link rel="shortcut icon" href="/favicon.ico"><script src="https://js.other.example/a.js"></script>'))
        .otherwise(F.lit('<link rel="icon" href="https://static.other.example/f.ico"><a href="#">top</a><a href="javascript:void(0)">x</a>')),
        F.when(n % 5 == 0, F.lit('<div onMouseOver="x()">h</div><a href="https://partner.example/p">p</a>'))
        .when(n % 5 == 1, F.lit("<p oncontextmenu=\"return false\">r</p><script>window.open('a')</script>"))
        .when(n % 5 == 2, F.lit("<meta name=\"description\" content=\"About  page &amp; more\">"))
        .otherwise(F.lit("<a href='http://far.example.org/q?a=1&amp;b=2'>f</a>")),
    )
    return pages.withColumn("html", F.replace("html", F.lit("</body>"), F.concat(extra, F.lit("</body>"))))


def urls(pages: DataFrame) -> DataFrame:
    """Page URLs plus reshaped variants so every URL rule has rows on both sides."""
    n, u = F.col("page_id"), F.col("url")
    domain = F.regexp_extract(u, "^https?://([^/:?#]*)", 1)
    variant = (
        F.when(n % 8 == 0, F.concat(F.lit("http://192.168."), (n % 200).cast("string"), F.lit(".7/a")))
        .when(n % 8 == 1, F.concat(F.lit("  "), domain, F.lit(":8080/x "),))
        .when(n % 8 == 2, F.concat(F.lit("http://user@"), domain, F.lit(":443/y")))
        .when(n % 8 == 3, F.concat(F.lit("https://bit.ly/"), n.cast("string"), F.lit("//r")))
        .when(n % 8 == 4, F.concat(F.lit("http://secure-https."), domain, F.lit("/"), F.repeat(F.lit("a"), (n % 60).cast("int"))))
        .when(n % 8 == 5, F.concat(F.lit("http://my-bank.com/?u="), u))
        .when(n % 8 == 6, F.concat(F.lit("http://0x7f000001/"), n.cast("string")))
        .otherwise(F.concat(F.lit("a.b."), domain))
    )
    return pages.select(
        F.col("page_id").alias("url_id"),
        F.explode(F.array(u, variant)).alias("url"),
    )


def domain_facts(pages: DataFrame) -> DataFrame:
    """One row of externally gathered facts per domain; some domains have none."""
    domain = F.regexp_extract("url", "^https?://([^/:?#]*)", 1)
    n = F.length("domain")
    return (
        pages.select(domain.alias("domain")).distinct().where(n % 7 != 0).select(
            "domain",
            (n % 4 != 0).alias("dns_ok"),
            F.expr("CASE length(domain) % 3 WHEN 0 THEN TIMESTAMP_NTZ'2023-01-01' WHEN 1 THEN TIMESTAMP_NTZ'2030-01-01' END").alias("not_after"),
            F.when(n % 2 == 0, "DigiCert Inc").otherwise("Example Org").alias("issuer_org"),
            F.when(n % 5 != 0, F.date_sub(F.to_date(F.lit("2024-06-01")), (n * 13).cast("int"))).alias("created"),
            F.when(n % 5 != 1, F.date_add(F.to_date(F.lit("2024-06-01")), (n * 17 - 150).cast("int"))).alias("expires"),
            F.when(n % 6 == 0, F.lit("registrar.example")).when(n % 6 != 1, F.col("domain")).alias("whois_domain"),
            F.when(n % 6 != 1, (n % 5).cast("int")).alias("redirects"),
            (n % 6 != 1).alias("whois_ok"),
        )
    )


def host_lists(events: DataFrame, supplier: DataFrame) -> DataFrame:
    """Maintenance log of the address lists: one entry per listed host, some re-listed."""
    no = F.col("s_suppkey")
    inner = F.concat(F.lit("10.1."), F.floor(no / 250).cast("int").cast("string"), F.lit("."), (no % 250).cast("string"))
    hosts = (
        events.select("user_id").distinct().select(F.col("user_id").alias("no"), _event_host().alias("ip"))
        .unionByName(supplier.select(no.alias("no"), inner.alias("ip")))
    )
    first = hosts.where(F.col("no") % 11 < 3).select(
        "ip", F.lit(1).cast("bigint").alias("seq"),
        F.when(F.col("no") % 11 == 0, "whitelist").otherwise("blacklist").alias("list_name"))
    again = hosts.where(F.col("no") % 33 == 1).select(
        "ip", F.lit(2).cast("bigint").alias("seq"), F.lit("whitelist").alias("list_name"))
    return first.unionByName(again)


def predictions(traffic_rows: DataFrame) -> DataFrame:
    return traffic_rows.select(
        "id",
        (F.col("threat_type") != "benign").cast("int").alias("y_true"),
        (F.col("risk_score") >= 0.5).cast("int").alias("y_pred"),
        F.col("risk_score").alias("score"),
    )


def decisions(traffic_rows: DataFrame) -> DataFrame:
    """Response decisions in order; action codes follow the 7-action policy."""
    code = (
        F.when(F.col("action") == "allow", 0).when(F.col("action") == "block", 1)
        .when(F.col("action") == "alert", 2).when(F.col("action") == "log", 3).otherwise(4)
    )
    return traffic_rows.select(
        F.col("id").alias("seq"), code.alias("action"),
        (F.col("threat_type") != "benign").alias("is_attack"),
        F.col("risk_score").alias("threat_score"),
    )


def model_scores(traffic_rows: DataFrame) -> DataFrame:
    n = F.col("id")
    return traffic_rows.select(
        "id",
        F.when(n % 5 != 0, F.col("risk_score")).alias("statistical"),
        F.when(n % 3 != 0, (n * 7 % 101) / 100.0).alias("text"),
        F.when(n % 4 == 1, (n * 13 % 97) / 96.0).alias("visual"),
    )


def attacks(lineitem: DataFrame, names: list[str]) -> DataFrame:
    picked = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_orderkey") % len(names) + 1).cast("int"))
    return lineitem.select(
        F.col("l_orderkey").alias("flow_no"), F.col("l_linenumber").alias("flow_line"),
        picked.alias("attack_type"),
    )


def connections(lineitem: DataFrame, names: list[str]) -> DataFrame:
    """Connection records with the 41 columns of the headerless benchmark file."""
    from tidewatch.schemas import KDD_CATEGORICAL, KDD_FEATURES

    picked = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_orderkey") % len(names) + 1).cast("int"))
    cols = []
    for j, name in enumerate(KDD_FEATURES):
        if name == "protocol_type":
            cols.append(F.when(F.col("l_returnflag") == "A", "udp").when(F.col("l_returnflag") == "R", "icmp").otherwise("tcp").alias(name))
        elif name == "service":
            cols.append(F.concat(F.lit("svc_"), (F.col("l_partkey") % 9).cast("string")).alias(name))
        elif name == "flag":
            cols.append(F.when(F.col("l_linestatus") == "O", "SF").otherwise("S0").alias(name))
        elif name in ("duration",):
            cols.append((F.col("l_quantity") * 10).alias(name))
        elif name in ("src_bytes", "dst_bytes"):
            cols.append(F.floor(F.col("l_extendedprice") * (j + 1)).cast("double").alias(name))
        elif name.endswith("_rate"):
            cols.append((((F.col("l_orderkey") * (j + 1) + F.col("l_partkey")) % 101) / 100.0).alias(name))
        else:
            cols.append(((F.col("l_orderkey") * (j + 2) + F.col("l_suppkey")) % (300 if "count" in name else 3)).cast("double").alias(name))
    assert set(KDD_CATEGORICAL) <= set(KDD_FEATURES)
    return lineitem.select(
        F.col("l_orderkey").alias("flow_no"), F.col("l_linenumber").alias("flow_line"),
        *cols, picked.alias("attack_type"),
    )
