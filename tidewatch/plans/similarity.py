"""Nearest neighbours, look-alikes, outliers and neighbour imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import pages as pages_op
from tidewatch.operators import similarity as S
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import query
from tidewatch.plans.urls import CLAIMED_SQL, SITE_NAMES, official_sites, site_claims
from tidewatch.schemas import PHISHING_FEATURES as FEATURES

_EMB = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v, label FROM embeddings)"
_IP = """ip AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(array_inner_product(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
ir AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM ip)"""
_EU = """eu AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(array_distance(a.v, b.v), 9) AS d, b.label FROM e a JOIN e b ON a.vec_id <> b.vec_id),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM eu)"""


@query("similar_embeddings", "J6 D20", f"WITH {_EMB}, {_IP} SELECT query_id, item_id, CAST(rank AS INT) AS rank, round(s, 6) AS similarity FROM ir WHERE rank <= 5")
def similar_embeddings(t):
    near = S.nearest(t.embeddings, t.embeddings, 5, "vec_id", "embedding", metric="inner", skip_self=True)
    return near.select("query_id", "item_id", "rank", F.round("measure", 6).alias("similarity"))


_SITES = "list_value(" + ", ".join(f"'{s}'" for s in SITE_NAMES) + ")"


@query("lookalike_pages", "J7", f"""WITH {CLAIMED_SQL}, {_EMB}, {_IP},
best AS (SELECT page_id, {_SITES}[CAST(item_id % {len(SITE_NAMES)} + 1 AS INT)] AS site, c.domain, s AS similarity FROM claimed c JOIN ir ON query_id = page_id WHERE rank = 1),
off AS (SELECT *, EXISTS (SELECT 1 FROM sites z WHERE z.site = b.site AND (b.domain = z.official OR ends_with(b.domain, '.' || z.official))) AS is_official FROM best b)
SELECT page_id, site, domain, round(similarity, 6) AS similarity, is_official, similarity >= 0.3 AND NOT is_official AS is_phishing,
 round(CASE WHEN similarity >= 0.3 AND NOT is_official THEN similarity ELSE 0 END, 6) AS confidence FROM off""")
def lookalike_pages(t):
    claims = site_claims(t.pages, t.spark).drop("site")
    top = S.nearest(t.embeddings, t.embeddings, 1, "vec_id", "embedding", metric="inner", skip_self=True)
    site = F.element_at(F.array(*[F.lit(s) for s in SITE_NAMES]), (F.col("item_id") % len(SITE_NAMES) + 1).cast("int"))
    matched = claims.join(top.withColumnRenamed("query_id", "page_id"), "page_id").select(
        "page_id", "domain", site.alias("site"), F.col("measure").alias("similarity"))
    flagged = pages_op.official_match(matched, official_sites(t.spark))
    # these embeddings are nearly orthogonal, so the usual 0.85 would show one branch only
    return S.lookalikes(flagged, threshold=0.3).select(
        "page_id", "site", "domain", F.round("similarity", 6).alias("similarity"), "is_official", "is_phishing", F.round("confidence", 6).alias("confidence"))


def _vote(k: int) -> str:
    return f"""WITH {_EMB}, {_EU}, vt AS (SELECT query_id, label, count(*) AS c FROM er WHERE rank <= {k} GROUP BY 1, 2),
 vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, label) AS r FROM vt) SELECT query_id, label AS predicted FROM vr WHERE r = 1"""


@query("neighbour_labels", "J10", _vote(5))
def neighbour_labels(t):
    return S.knn_classify(t.embeddings, t.embeddings, "label", 5, "vec_id", "embedding", skip_self=True)


@query("neighbour_labels_k3", "J10", _vote(3))
def neighbour_labels_k3(t):
    return S.knn_classify(t.embeddings, t.embeddings, "label", 3, "vec_id", "embedding", skip_self=True)


@query("embedding_outliers", "M29", f"""WITH {_EMB}, {_EU}, nb AS (SELECT query_id, item_id, d FROM er WHERE rank <= 20),
kd AS (SELECT query_id, max(d) AS kd FROM nb GROUP BY 1),
lr AS (SELECT nb.query_id, 1/(avg(greatest(d, kd)) + 1e-10) AS density FROM nb JOIN kd ON kd.query_id = nb.item_id GROUP BY 1),
lf AS (SELECT nb.query_id, avg(o.density) AS around FROM nb JOIN lr o ON o.query_id = nb.item_id GROUP BY 1)
SELECT query_id AS id, round(around/density, 6) AS lof FROM lf JOIN lr USING (query_id)""")
def embedding_outliers(t):
    return S.local_outlier_factor(t.embeddings, 20, "vec_id", "embedding").withColumn("lof", F.round("lof", 6))


_PAT = "concat_ws(',', " + ", ".join(f"coalesce(CAST(CAST(\"{c}\" AS DOUBLE) AS VARCHAR), '_')" for c in FEATURES) + ")"
_CELLS = "[" + ", ".join(f"CAST(\"{c}\" AS DOUBLE)" for c in FEATURES) + "]"
_KNN = f""",
pat AS (SELECT {_PAT} AS pattern, any_value({_CELLS}) AS cells, count(*) AS n FROM phishing GROUP BY 1),
lng AS (SELECT pattern, n, unnest(cells) AS v, generate_subscripts(cells, 1) - 1 AS c FROM pat),
pr AS (SELECT a.pattern AS q, b.pattern AS d, sum((a.v-b.v)*(a.v-b.v)) AS sq, count(*) AS shared FROM lng a JOIN lng b ON a.c = b.c AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2),
ds AS (SELECT q, d, round(sqrt(sq * 30 / shared), 9) AS dist FROM pr),
cd AS (SELECT m.pattern AS pattern, m.c, x.dist, g.pattern AS donor, g.v, g.n, sum(g.n) OVER (PARTITION BY m.pattern, m.c ORDER BY x.dist, g.pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM lng m JOIN ds x ON x.q = m.pattern JOIN lng g ON g.pattern = x.d AND g.c = m.c AND g.v IS NOT NULL WHERE m.v IS NULL),
wt AS (SELECT pattern, c, v, least(n, 3 - coalesce(before, 0)) AS w FROM cd),
fills AS (SELECT pattern, c, sum(v*w)/sum(w) AS fill FROM wt WHERE w > 0 GROUP BY 1, 2),
keyed_rows AS (SELECT *, {_PAT} AS pattern FROM phishing),
wide_fills AS (SELECT pattern, {', '.join(f'max(fill) FILTER (c = {i}) AS f{i}' for i in range(30))} FROM fills GROUP BY 1)
"""


@query("neighbour_imputed_rows", "M7", with_views("phishing", _KNN + "SELECT row_id, " + ", ".join(
    f"round(coalesce(CAST(\"{c}\" AS DOUBLE), f{i}), 6) AS \"{c}\"" for i, c in enumerate(FEATURES)) + " FROM keyed_rows LEFT JOIN wide_fills USING (pattern)"))
def neighbour_imputed_rows(t):
    return S.knn_impute(t.phishing, FEATURES, k=3).select("row_id", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("smote_classes", "M13", with_views("phishing", """SELECT "Result" AS label, (SELECT max(c) FROM (SELECT count(*) AS c FROM phishing GROUP BY "Result")) AS cnt FROM phishing GROUP BY 1"""))
def smote_classes(t):
    from tidewatch.operators.sampling import balance

    out = balance(t.phishing, "Result", ["row_id"], "smote", features=FEATURES)
    return out.groupBy(F.col("Result").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
