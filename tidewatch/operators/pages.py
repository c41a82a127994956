"""Feature tables over URLs and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import html as H
from tidewatch.functions import url as U
from tidewatch.runtime import spread
from tidewatch.schemas import PHISHING_FEATURES


def url_structure(urls: DataFrame, url: str = "url", strict_shorteners: bool = False) -> DataFrame:
    return U.parse(urls, url).withColumns(U.structure_features(strict_shorteners))


def with_facts(parsed: DataFrame, facts: DataFrame) -> DataFrame:
    """Left join to the domain facts; both sides move on the domain unless facts are small."""
    return parsed.join(facts, "domain", "left")


def phishing_features(
    pages: DataFrame, facts: DataFrame, as_of: dt.datetime, url: str = "url", html: str = "html",
    strict_shorteners: bool = False,
) -> DataFrame:
    """The 30 features per URL, in schema order, after the columns of the page table.

    Only the URL crosses the join with the facts: features of the page are computed before
    it, so page bodies are never shuffled.
    """
    keep = [c for c in pages.columns if c != html]
    own = H.with_markup(U.parse(spread(pages), url), html).withColumns(
        {**U.structure_features(strict_shorteners), **H.page_features(html)})
    fact = U.fact_features(as_of)
    own = own.select(*keep, "domain", *[c for c in PHISHING_FEATURES if c not in fact])
    return with_facts(own, facts).withColumns(fact).select(*keep, *PHISHING_FEATURES)


def official_match(domains: DataFrame, sites: DataFrame, domain: str = "domain", site: str = "site") -> DataFrame:
    """Add ``is_official``: the domain equals an official domain of its site or ends with
    ``'.' + official``.

    Every domain is expanded to its own suffixes (as many as it has labels), which turns
    the suffix test into an equi-join on (site, suffix).
    """
    name = F.lower(F.trim(F.col(domain)))
    labels = F.split("_name", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    wanted = sites.select(F.lower("site").alias("_site"), F.col("official").alias("_suffix")).distinct()
    pairs = domains.select(F.lower(F.col(site)).alias("_site"), name.alias("_name")).distinct()
    hits = (
        pairs.withColumn("_suffix", F.explode(suffixes))
        .join(wanted, ["_site", "_suffix"]).select("_site", "_name").distinct().withColumn("_hit", F.lit(True))
    )
    joined = domains.withColumn("_site", F.lower(F.col(site))).withColumn("_name", name)
    return (
        joined.join(hits, ["_site", "_name"], "left")
        .withColumn("is_official", F.coalesce("_hit", F.lit(False)))
        .select(*domains.columns, "is_official")
    )
