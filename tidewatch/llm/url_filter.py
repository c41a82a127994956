"""URL filter by a path-template tree, built of DataFrame operations only.

Every distinct path is put into the tree of its host and into one tree of all hosts. Level by
level a segment that only one path, or a small share of its parent's, holds becomes the wildcard ``*``; a common segment
whose labelled share of blocked paths cannot be told from that of its siblings (a two-proportion
test) is merged with them into the branch ``~``; the others keep their name. That goes on until no
path has a segment left. A template is judged by the share of blocked paths among its labelled ones, smoothed towards the share of the
template in the tree of all hosts, which in turn is smoothed towards one half. The labels are the
verdicts of a short list of rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, shared_dir

#: A segment held by less than one in so many paths of its parent is variable.
RARE = 50
#: Weight, in labelled paths, of the share that smooths a template's own.
WEIGHT = 2.0
#: Square of the normal quantile at which branches count as different.
Z2 = 3.84
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does.

    A rule ``host/path`` fits its host and all subdomains when the path starts with its own.
    """
    fits = []
    for verdict, rule in rules:
        own, slash, tail = rule.partition("/")
        fit = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def _grown(paths: DataFrame, level: int, rare: int) -> DataFrame:
    """Add the branch of segment ``level`` to the template of every path; all paths have that segment.

    A path that is alone in its template has its further branches all alike, so it gets them at once.
    """
    here = paths.withColumn("segment", F.get("segments", F.lit(level)))
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    child = here.groupBy("tree", "template", "segment").agg(*sums, F.count("*").alias("paths"))
    parent = child.groupBy("tree", "template").agg(*(F.sum(c).alias("all_" + c) for c in ("n", "blocked", "labelled", "paths")))
    d = {c: F.col(c).cast("double") for c in ("blocked", "labelled", "all_blocked", "all_labelled")}
    other_blocked, other_labelled = d["all_blocked"] - d["blocked"], d["all_labelled"] - d["labelled"]
    gap = d["blocked"] * other_labelled - other_blocked * d["labelled"]
    spread = d["labelled"] * other_labelled * d["all_blocked"] * (d["all_labelled"] - d["all_blocked"])
    variable = (F.col("n") * rare < F.col("all_n")) | (F.col("n") < 2)
    apart = ~variable & (spread > 0) & (gap * gap * d["all_labelled"] > Z2 * spread)
    alone = (F.col("all_paths") == 1) | apart & (F.col("paths") == 1) & ~F.col("segment").isin("*", "~")
    branch = F.when(variable, "*").when(apart, F.col("segment")).otherwise("~")
    named = child.join(parent, ["tree", "template"]).select("tree", "template", "segment", branch.alias("branch"), alone.alias("alone"))
    left = F.size("segments") - level - 1
    rest = F.when(F.col("alone"), F.repeat(F.when(F.col("n") < 2, "/*").otherwise("/~"), left)).otherwise("")
    grown = here.join(named, ["tree", "template", "segment"])
    return grown.select("host", "path", "segments", "tree", F.concat("template", F.lit("/"), "branch", rest).alias("template"), "n", "blocked", "labelled",
                        (F.col("alone") | (left == 0)).alias("done"))


def template_tree(paths: DataFrame, rare: int = RARE) -> DataFrame:
    """The templates of all paths, level by level until no path has a segment left.

    ``paths`` holds host, path, segments, tree, n, blocked and labelled. Finished paths take no part in the next
    level; the number of levels is that of the longest path among those that stay together.
    """
    spark = paths.sparkSession
    finished = shared_dir(spark, "url-templates")
    names = ["host", "path", "tree", "template", "n", "blocked", "labelled"]
    start = paths.withColumn("template", F.lit(""))
    start.where(F.size("segments") == 0).select(names).write.parquet(finished)
    todo, level = start.where(F.size("segments") > 0), 0
    while True:
        grown = materialize(_grown(todo, level, rare), "url-tree")
        grown.where("done").select(names).write.mode("append").parquet(finished)
        todo, level = grown.where("NOT done").drop("done"), level + 1
        if todo.isEmpty():
            return spark.read.parquet(finished)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], rare: int = RARE, weight: float = WEIGHT,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every URL: the longest rule's, else that of its path template.

    Returns one row per input row: id, host, path, rule (null if none fits), verdict (``allow``
    or ``block``), template and the template's smoothed share of blocked paths. A null or empty
    URL, or one without ``://``, has empty host and path and the empty template. Paths of any depth
    are told apart segment by segment. A share of exactly one half allows. Further columns are not read; an empty table gives an empty result.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("blocked"), F.count("fit").alias("labelled"))
    tree = paths.select("host", "path", F.filter(F.split("path", "/"), lambda s: s != "").alias("segments"),
                        F.explode(F.array(F.concat(F.lit("host:"), "host"), F.lit("all"))).alias("tree"), "n", "blocked", "labelled")
    tree = template_tree(tree, rare)
    votes = tree.groupBy("tree", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    general = votes.where("tree = 'all'").select(F.col("template").alias("wide"), ((F.col("blocked") + 1.0) / (F.col("labelled") + 2.0)).alias("wide_share"))
    own = votes.where("tree <> 'all'").select("tree", "template", "blocked", "labelled")
    of_path = (tree.where("tree <> 'all'").select("host", "path", "tree", "template")
               .join(tree.where("tree = 'all'").select("host", "path", F.col("template").alias("wide")), ["host", "path"])
               .join(own, ["tree", "template"]).join(general, "wide")
               .select("host", "path", "template", ((F.col("blocked") + weight * F.col("wide_share")) / (F.col("labelled") + weight)).alias("share")))
    judged = rows.join(of_path, ["host", "path"])
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("share") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "share")


def judge_urls_sql(rules: Sequence[tuple[str, str]], source: str = "pages") -> str:
    """The same judgement for DuckDB."""
    values = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in rules)
    return rf"""
WITH RECURSIVE rules(verdict, rule, rule_host, rule_path) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {source}),
h AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
q AS (SELECT r, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT r, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS fit
    FROM q JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
g AS (SELECT q.*, f.rule, f.fit FROM q LEFT JOIN f USING (r)),
d AS (SELECT host, path, count(*) AS n, count(*) FILTER (fit = 'block') AS blocked, count(fit) AS labelled FROM g GROUP BY ALL),
t AS (SELECT 0 AS level, host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, unnest(['host:' || host, 'all']) AS tree, '' AS template,
    n::HUGEINT AS n, blocked::HUGEINT AS blocked, labelled::HUGEINT AS labelled FROM d
  UNION ALL
  SELECT level + 1, host, path, segments, tree, template || '/' || CASE WHEN c_n * {RARE} < all_n OR c_n < 2 THEN '*'
    WHEN c_l * (all_l - c_l) * all_b * (all_l - all_b) > 0
     AND pow(c_b::DOUBLE * (all_l - c_l) - (all_b - c_b) * c_l::DOUBLE, 2) * all_l > {Z2} * (c_l::DOUBLE * (all_l - c_l) * all_b * (all_l - all_b))
    THEN segment ELSE '~' END, n, blocked, labelled
  FROM (SELECT *, segments[level + 1] AS segment, sum(n) OVER c AS c_n, sum(blocked) OVER c AS c_b, sum(labelled) OVER c AS c_l,
        sum(n) OVER p AS all_n, sum(blocked) OVER p AS all_b, sum(labelled) OVER p AS all_l
    FROM t WHERE len(segments) > level WINDOW c AS (PARTITION BY tree, template, segments[level + 1]), p AS (PARTITION BY tree, template))),
e AS (SELECT * FROM t WHERE level = len(segments)),
v AS (SELECT tree, template, sum(blocked) AS blocked, sum(labelled) AS labelled FROM e GROUP BY ALL),
w AS (SELECT o.host, o.path, o.template, (vo.blocked + {WEIGHT} * ((va.blocked + 1.0::DOUBLE) / (va.labelled + 2.0::DOUBLE))) / (vo.labelled + {WEIGHT}::DOUBLE) AS share
    FROM e o JOIN e a ON o.host = a.host AND o.path = a.path AND o.tree <> 'all' AND a.tree = 'all'
    JOIN v vo ON vo.tree = o.tree AND vo.template = o.template JOIN v va ON va.tree = 'all' AND va.template = a.template)
SELECT page_id, g.host, g.path, rule, coalesce(fit, CASE WHEN share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template
FROM g JOIN w ON g.host = w.host AND g.path = w.path"""
