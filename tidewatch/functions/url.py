"""URL features as column expressions; values are -1 (suspicious), 0 or 1."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
SHORTENERS = ["bit.ly", "goo.gl", "t.co", "tinyurl.com", "ow.ly", "is.gd", "buff.ly",
              "adf.ly", "bit.do", "mcaf.ee", "su.pr", "yourls.org", "cutt.ly", "rb.gy"]
USUAL_PORTS = [80, 443, 21, 22, 23, 25, 53, 110, 143, 993, 995]
TRUSTED_ISSUERS = ["digicert", "let's encrypt", "comodo", "geotrust", "globalsign",
                   "symantec", "thawte", "verisign"]
KNOWN_TLDS = [".com", ".org", ".net", ".edu", ".gov"]

NETLOC = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def flag(bad: Column) -> Column:
    return F.when(bad, -1).otherwise(1)


def any_literal(texts: list[str]) -> str:
    return "|".join(t.replace(".", "\\.") for t in texts)


def normalize(url: Column) -> Column:
    """Trim and put ``http://`` before a URL without scheme (the test is case-sensitive)."""
    bare = F.regexp_replace(url, r"^\s+|\s+$", "")
    return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("http://"), bare))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def domain_of(url: Column) -> Column:
    """Everything of the network location before its first colon, user info included."""
    return F.regexp_extract(netloc(url), "^([^:]*)", 1)


def parse(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the parts of a normalised URL."""
    u = F.col("norm_url")
    return (
        df.withColumn("norm_url", normalize(F.col(url)))
        .withColumn("scheme", F.regexp_extract(u, "^([a-z]+)://", 1))
        .withColumn("netloc", netloc(u))
        .withColumn("path", F.regexp_extract(u, "^https?://[^/?#]*([^?#]*)", 1))
        .withColumn("query", F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1))
        .withColumn("domain", F.regexp_extract("netloc", "^([^:]*)", 1))
        .withColumn("port_text", F.regexp_extract("netloc", "(?:^|@)[^@:]*:([^@]*)$", 1))
    )


def second_label(domain: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(domain, "[.]"), F.lit(-2)), domain)


def structure_features(strict_shorteners: bool = False) -> dict[str, Column]:
    """The nine features that need only the URL; input columns come from ``parse``.

    By default a shortener name anywhere in the domain counts (so ``t.co`` also hits
    ``microsoft.com``); ``strict_shorteners`` asks for the name itself or a subdomain.
    """
    u, d = F.col("norm_url"), F.col("domain")
    names = any_literal(SHORTENERS)
    pattern = f"(^|[.])({names})$" if strict_shorteners else names
    dots = F.length(F.regexp_replace(F.regexp_replace(d, r"^www\.", ""), "[^.]", ""))
    return {
        "having_IP_Address": flag(u.rlike(r"([0-9]{1,3}\.){3}[0-9]{1,3}|0x[0-9a-fA-F]+")),
        "URL_Length": F.when(F.length(u) < 54, 1).when(F.length(u) <= 75, 0).otherwise(-1),
        "Shortining_Service": flag(F.lower(d).rlike(pattern)),
        "having_At_Symbol": flag(u.contains("@")),
        "double_slash_redirecting": flag(F.element_at(F.split(u, "://"), -1).contains("//")),
        "Prefix_Suffix": flag(second_label(d).contains("-")),
        "having_Sub_Domain": F.when(dots <= 1, 1).when(dots == 2, 0).otherwise(-1),
        "HTTPS_token": flag(F.lower(d).contains("https")),
        "port": F.when((F.col("port_text") == "") | F.coalesce(F.col("port_text").try_cast("int").isin(USUAL_PORTS), F.lit(False)), 1).otherwise(-1),
        "web_traffic": F.when(d.rlike(f"({any_literal(KNOWN_TLDS)})$"),
                              F.when(F.length(second_label(d)) <= 10, 1).otherwise(0)).otherwise(-1),
    }


def fact_features(as_of: dt.datetime) -> dict[str, Column]:
    """Features read from gathered domain facts; a missing fact counts as a failed probe."""
    issuer = F.lower(F.coalesce("issuer_org", F.lit(""))).rlike("|".join(TRUSTED_ISSUERS))
    ssl = F.when(F.col("not_after").isNull() | (F.col("not_after") < F.lit(as_of).cast("timestamp_ntz")), -1).when(issuer, 1).otherwise(0)
    dns = F.when(F.col("dns_ok"), 1).otherwise(-1)

    def at_least(days: Column, bound: int) -> Column:
        return F.when(days >= bound, 1).otherwise(-1)

    whois = F.coalesce("whois_ok", F.lit(False))
    foreign = F.coalesce(~F.lower("whois_domain").contains(F.lower("domain")), F.lit(False))
    return {
        "SSLfinal_State": ssl,
        "DNSRecord": dns,
        "age_of_domain": at_least(F.datediff(F.lit(as_of.date()), "created"), 180),
        "Domain_registeration_length": at_least(F.datediff("expires", "created"), 365),
        "Abnormal_URL": F.when(whois & ~foreign, 1).otherwise(-1),
        "Redirect": F.when(F.col("redirects") <= 1, 0).when(F.col("redirects") <= 3, 1).otherwise(-1),
        "Page_Rank": F.when((dns == 1) & (ssl == 1), 1).otherwise(-1),
        "Google_Index": dns,
        "Statistical_report": F.when((dns == 1) & (ssl >= 0), 1).otherwise(-1),
    }
