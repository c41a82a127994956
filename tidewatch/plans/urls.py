"""URL and page features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions import html as H
from tidewatch.functions import url as U
from tidewatch.operators import pages as op
from tidewatch.plans.oracle_views import with_views
from tidewatch.plans.registry import query
from tidewatch.schemas import PHISHING_FEATURES

AS_OF = dt.datetime(2024, 6, 1)

PARSED = r""",
n_a AS (SELECT *, regexp_replace(url, '^\s+|\s+$', '', 'g') AS bare FROM {src}),
n_b AS (SELECT *, CASE WHEN regexp_matches(bare, '^https?://') THEN bare ELSE 'http://' || bare END AS norm_url FROM n_a),
n_c AS (SELECT *, regexp_extract(norm_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc FROM n_b),
parsed AS (SELECT *, regexp_extract(netloc, '^([^:]*)', 1) AS domain, regexp_extract(netloc, '(?:^|@)[^@:]*:([^@]*)$', 1) AS port_text,
  regexp_extract(norm_url, '^([a-z]+)://', 1) AS scheme, regexp_extract(norm_url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(norm_url, '^[^?#]*\?([^#]*)', 1) AS query FROM n_c)
"""

_SECOND = "coalesce(split(domain,'.')[-2], domain)"
_SHORT = "|".join(n.replace(".", "\\.") for n in U.SHORTENERS)
STRUCT_SQL = {
    "having_IP_Address": r"CASE WHEN regexp_matches(norm_url, '([0-9]{1,3}\.){3}[0-9]{1,3}') OR regexp_matches(norm_url, '0x[0-9a-fA-F]+') THEN -1 ELSE 1 END",
    "URL_Length": "CASE WHEN length(norm_url) < 54 THEN 1 WHEN length(norm_url) <= 75 THEN 0 ELSE -1 END",
    "Shortining_Service": f"CASE WHEN regexp_matches(lower(domain), '{_SHORT}') THEN -1 ELSE 1 END",
    "having_At_Symbol": "CASE WHEN contains(norm_url, '@') THEN -1 ELSE 1 END",
    "double_slash_redirecting": "CASE WHEN contains(string_split(norm_url,'://')[-1], '//') THEN -1 ELSE 1 END",
    "Prefix_Suffix": f"CASE WHEN contains({_SECOND}, '-') THEN -1 ELSE 1 END",
    "having_Sub_Domain": r"CASE WHEN length(regexp_replace(regexp_replace(domain,'^www\.',''),'[^.]','','g')) <= 1 THEN 1 WHEN length(regexp_replace(regexp_replace(domain,'^www\.',''),'[^.]','','g')) = 2 THEN 0 ELSE -1 END",
    "HTTPS_token": "CASE WHEN contains(lower(domain), 'https') THEN -1 ELSE 1 END",
    "port": "CASE WHEN port_text = '' OR TRY_CAST(port_text AS INT) IN (80,443,21,22,23,25,53,110,143,993,995) THEN 1 ELSE -1 END",
    "web_traffic": rf"CASE WHEN NOT regexp_matches(domain, '\.(com|org|net|edu|gov)$') THEN -1 WHEN length({_SECOND}) <= 10 THEN 1 ELSE 0 END",
}
_SSL = """CASE WHEN not_after IS NULL OR not_after < TIMESTAMP '2024-06-01' THEN -1
 WHEN regexp_matches(lower(coalesce(issuer_org,'')), 'digicert|let''s encrypt|comodo|geotrust|globalsign|symantec|thawte|verisign') THEN 1 ELSE 0 END"""
_DNS = "CASE WHEN dns_ok THEN 1 ELSE -1 END"
FACT_SQL = {
    "SSLfinal_State": _SSL, "DNSRecord": _DNS, "Google_Index": _DNS,
    "age_of_domain": "CASE WHEN date_diff('day', created, DATE '2024-06-01') >= 180 THEN 1 ELSE -1 END",
    "Domain_registeration_length": "CASE WHEN date_diff('day', created, expires) >= 365 THEN 1 ELSE -1 END",
    "Abnormal_URL": "CASE WHEN whois_ok AND NOT coalesce(NOT contains(lower(whois_domain), lower(domain)), false) THEN 1 ELSE -1 END",
    "Redirect": "CASE WHEN redirects <= 1 THEN 0 WHEN redirects <= 3 THEN 1 ELSE -1 END",
    "Page_Rank": f"CASE WHEN {_DNS} = 1 AND {_SSL} = 1 THEN 1 ELSE -1 END",
    "Statistical_report": f"CASE WHEN {_DNS} = 1 AND {_SSL} >= 0 THEN 1 ELSE -1 END",
}

_ATTRS = r"""[^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*"""


#: The references that the given pages hold; the twin needs no others.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def _unescape(x: str) -> str:
    for entity, char in _ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _tags(src: str, names: str) -> str:
    return rf"regexp_extract_all({src}, '(?is)<(?:{names})\b{_ATTRS}>', 0)"


def _attr(tag: str, name: str) -> str:
    pat = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))"""
    return _unescape("concat(" + ", ".join(f"regexp_extract({tag}, '{pat}', {g})" for g in (1, 2, 3)) + ")")


def _has(tag: str, name: str) -> str:
    return rf"regexp_matches({tag}, '(?is)\s{name}[\s=>/]')"


def _tidy(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'))"


_MARK = "regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
for _t in ("script", "style"):
    _MARK = rf"regexp_replace({_MARK}, '(?is)(<{_t}\b{_ATTRS.replace('{', '{{').replace('}', '}}')}>).*?</{_t}\s*>', '\1', 'g')"
CLEAN = _MARK.format(x="html")


def _dom(link: str) -> str:
    return f"regexp_extract(regexp_extract({link}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^([^:]*)', 1)"


def _foreign(link: str) -> str:
    return f"(regexp_matches({link}, '^https?://') AND NOT contains({_dom(link)}, domain))"


MARKED = f""",
m_a AS (SELECT *, {CLEAN} AS clean FROM parsed),
marked AS (SELECT *,
 [{_attr('t', 'href')} FOR t IN {_tags('clean', 'a')} IF {_has('t', 'href')}] AS anchors,
 len({_tags('clean', 'a')}) AS anchor_tags,
 [x FOR x IN [coalesce(nullif({_attr('t', 'src')},''), nullif({_attr('t', 'href')},'')) FOR t IN {_tags('clean', 'img|script|link')}] IF x IS NOT NULL] AS resources,
 [x FOR x IN [coalesce(nullif({_attr('t', 'src')},''), nullif({_attr('t', 'href')},''), nullif({_attr('t', 'content')},'')) FOR t IN {_tags('clean', 'meta|script|link')}] IF x IS NOT NULL AND regexp_matches(x, '^https?://')] AS refs,
 [{_attr('t', 'href')} FOR t IN {_tags('clean', 'link')} IF contains(lower({_attr('t', 'rel')}), 'icon')][1] AS icon,
 [{_attr('t', 'action')} FOR t IN {_tags('clean', 'form')} IF {_has('t', 'action')}] AS actions,
 len({_tags('clean', 'iframe')}) AS iframes FROM m_a)
"""


def _share(part: str, total: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {total} = 0 THEN 1 WHEN {part}*100e0/{total} < {lo} THEN 1 WHEN {part}*100e0/{total} <= {hi} THEN 0 ELSE -1 END"


_VERDICT = f"[a FOR a IN actions IF a IN ('','about:blank') OR {_foreign('a')}][1]"
PAGE_SQL = {
    "Favicon": f"CASE WHEN coalesce(icon,'') <> '' AND ((starts_with(icon,'/') AND NOT starts_with(icon,'//')) OR contains({_dom('icon')}, domain) OR contains(domain, {_dom('icon')})) THEN 1 ELSE -1 END",
    "Request_URL": _share(f"len([r FOR r IN resources IF {_foreign('r')}])", "len(resources)", 22, 61),
    "URL_of_Anchor": _share(f"len([a FOR a IN anchors IF a IN ('#','','javascript:void(0)','javascript:;') OR {_foreign('a')}])", "len(anchors)", 31, 67),
    "Links_in_tags": _share(f"len([r FOR r IN refs IF NOT contains({_dom('r')}, domain)])", "len(refs)", 17, 81),
    "SFH": f"CASE WHEN {_VERDICT} IS NULL THEN 1 WHEN {_VERDICT} IN ('','about:blank') THEN 0 ELSE -1 END",
    "Submitting_to_email": "CASE WHEN contains(html,'mailto:') OR contains(html,'mail(') THEN -1 ELSE 1 END",
    "on_mouseover": "CASE WHEN contains(lower(html),'onmouseover') THEN -1 ELSE 1 END",
    "RightClick": "CASE WHEN contains(lower(html),'event.button==2') OR contains(lower(html),'oncontextmenu') THEN -1 ELSE 1 END",
    "popUpWidnow": "CASE WHEN contains(lower(html),'window.open') OR contains(lower(html),'alert(') THEN -1 ELSE 1 END",
    "Iframe": "CASE WHEN iframes > 0 THEN -1 ELSE 1 END",
    "Links_pointing_to_page": "CASE WHEN anchor_tags > 50 THEN 1 WHEN anchor_tags > 10 THEN 0 ELSE -1 END",
}


def _cols(exprs: dict[str, str], names=None) -> str:
    return ", ".join(f'{exprs[n]} AS "{n}"' for n in (names or exprs))


@query("url_parts", "X0a X0b", with_views("urls", PARSED.format(src="urls") + "SELECT url_id, url, norm_url, scheme, netloc, path, query, domain, port_text FROM parsed"))
def url_parts(t):
    return U.parse(t.urls).select("url_id", "url", "norm_url", "scheme", "netloc", "path", "query", "domain", "port_text")


@query("url_structure_features", "X1 X2 X3 X4 X5 X6 X7 X8 X9 X26", with_views("urls", PARSED.format(src="urls") + f"SELECT url_id, url, {_cols(STRUCT_SQL)} FROM parsed"))
def url_structure_features(t):
    return op.url_structure(t.urls).select("url_id", "url", *STRUCT_SQL)


@query("domain_fact_features", "J8 X10 X11 X12 X13 X14 X15 X27 X28 X30", with_views("urls domain_facts", PARSED.format(src="urls") + f"SELECT url_id, url, {_cols(FACT_SQL)} FROM parsed LEFT JOIN domain_facts USING (domain)"))
def domain_fact_features(t):
    joined = op.with_facts(U.parse(t.urls), t.domain_facts)
    return joined.withColumns(U.fact_features(AS_OF)).select("url_id", "url", *FACT_SQL)


@query("page_markup_features", "X16 X17 X18 X19 X20 X21 X22 X23 X24 X25 X29 X31", with_views("rich_pages", PARSED.format(src="rich_pages") + MARKED + f"SELECT page_id, {_cols(PAGE_SQL)} FROM marked"))
def page_markup_features(t):
    marked = H.with_markup(U.parse(t.rich_pages))
    return marked.withColumns(H.page_features()).select("page_id", *PAGE_SQL)


@query("phishing_feature_table", "X32 D16", with_views("rich_pages domain_facts", PARSED.format(src="rich_pages") + MARKED + f"SELECT page_id, url, {_cols({**STRUCT_SQL, **FACT_SQL, **PAGE_SQL}, PHISHING_FEATURES)} FROM marked LEFT JOIN domain_facts USING (domain)"))
def phishing_feature_table(t):
    return op.phishing_features(t.rich_pages, t.domain_facts, AS_OF)


_TITLE = _tidy(_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
_DESC = _tidy("coalesce(" + _attr(f"[t FOR t IN {_tags('clean', 'meta')} IF {_attr('t', 'name')} = 'description'][1]", "content") + ", '')")
_BARE = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in H.HIDDEN_CONTAINERS:
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_t}\b{_ATTRS}>.*?</{_t}\s*>', ' ', 'g')"
TEXTS = rf""",
x_a AS (SELECT *, {CLEAN} AS clean, {_BARE} AS bare_html FROM {{src}}),
x_b AS (SELECT *, {_TITLE} AS title, {_DESC} AS description,
  CASE WHEN regexp_matches(bare_html, '(?i)<body\b') THEN regexp_extract(bare_html, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1) ELSE bare_html END AS inside FROM x_a),
texts AS (SELECT *, {_tidy(_unescape("regexp_replace(inside, '<[^>]*>', ' ', 'g')"))} AS text FROM x_b)
"""


@query("page_texts", "X33 X34 X35", with_views("rich_pages", TEXTS.replace("{src}", "rich_pages") + "SELECT page_id, title, description, text, length(text) AS text_length FROM texts"))
def page_texts(t):
    return H.page_content(t.rich_pages).select("page_id", "title", "description", "text", "text_length")


@query("page_model_text", "X39", with_views("rich_pages", TEXTS.replace("{src}", "rich_pages") + """SELECT page_id, whole_text, substr(whole_text, 1, 512) AS model_text FROM
 (SELECT page_id, concat_ws(' ', nullif(title,''), nullif(description,''), nullif(text,'')) AS whole_text FROM texts)"""))
def page_model_text(t):
    parts = [F.col(c) for c in ("title", "description", "text")]
    return H.page_content(t.rich_pages).select(
        "page_id", H.model_text(*parts, max_length=None).alias("whole_text"), H.model_text(*parts).alias("model_text"))


_FORMS = rf""",
f_a AS (SELECT *, {CLEAN} AS clean FROM parsed),
f_b AS (SELECT page_id, netloc, clean, regexp_extract_all(clean, '(?is)<form\b.*?(?:</form\s*>|\z)', 0) AS fs FROM f_a),
f_c AS (SELECT page_id, unnest(fs) AS f, generate_subscripts(fs, 1) - 1 AS form_no FROM f_b),
f_d AS (SELECT page_id, form_no, f, {_tags('f', 'form')}[1] AS head, unnest({_tags('f', 'input')}) AS i, generate_subscripts({_tags('f', 'input')}, 1) - 1 AS input_no FROM f_c)
"""


@query("page_forms", "X36", with_views("rich_pages", PARSED.format(src="rich_pages") + _FORMS + f"""SELECT page_id, CAST(form_no AS INT) AS form_no, CAST(input_no AS INT) AS input_no, {_attr('head', 'action')} AS action,
 upper(coalesce(nullif({_attr('head', 'method')},''),'get')) AS method, CASE WHEN {_has('i', 'type')} THEN {_attr('i', 'type')} ELSE 'text' END AS input_type,
 {_attr('i', 'name')} AS input_name, {_attr('i', 'placeholder')} AS placeholder FROM f_d"""))
def page_forms(t):
    one = H.page_content(t.rich_pages).select("page_id", F.posexplode("forms").alias("form_no", "f"))
    return one.select("page_id", "form_no", "f", F.posexplode("f.inputs").alias("input_no", "i")).select(
        "page_id", "form_no", "input_no", "f.action", "f.method", F.col("i.type").alias("input_type"),
        F.col("i.name").alias("input_name"), F.col("i.placeholder").alias("placeholder"))


_REAL = "[a FOR a IN anchors IF NOT regexp_matches(a, '^(javascript:|mailto:|#)')]"
_NET = "regexp_extract(a, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_INS = f"len([a FOR a IN {_REAL} IF {_NET} = '' OR {_NET} = netloc])"


@query("page_links_and_login", "X37 X38", with_views("rich_pages", PARSED.format(src="rich_pages") + MARKED + rf"""
SELECT page_id, {_INS} AS internal, len({_REAL}) - {_INS} AS external, len({_REAL}) AS total,
 regexp_matches(clean, '(?i)<form') AND contains(clean, 'type="password"') AS has_password_field FROM marked"""))
def page_links_and_login(t):
    return H.page_content(t.rich_pages).select("page_id", "links.internal", "links.external", "links.total", "has_password_field")


@query("page_tag_counts_parsed", "X31", with_views("rich_pages", PARSED.format(src="rich_pages") + MARKED + r""",
opened AS (SELECT page_id, lower(unnest(regexp_extract_all(clean, '(?s)<([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1))) AS tag FROM marked)
SELECT page_id, tag, count(*) AS cnt FROM opened GROUP BY ALL"""))
def page_tag_counts_parsed(t):
    found = t.rich_pages.select("page_id", F.explode(H.tag_names(H.markup(F.col("html")))).alias("tag"))
    return found.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("cnt"))


# --- fixed values: official domains of well-known sites -------------------------------
OFFICIAL_SITES = {
    "google": ["google.com", "google.cn", "accounts.google.com"],
    "facebook": ["facebook.com", "fb.com"],
    "amazon": ["amazon.com", "amazon.cn", "amazon.co.jp"],
    "paypal": ["paypal.com", "paypal.me"],
    "apple": ["apple.com", "icloud.com", "appleid.apple.com"],
    "microsoft": ["microsoft.com", "live.com", "outlook.com", "office.com"],
    "netflix": ["netflix.com"],
    "twitter": ["twitter.com", "x.com"],
    "instagram": ["instagram.com"],
    "linkedin": ["linkedin.com"],
    "alibaba": ["alibaba.com", "taobao.com", "tmall.com", "alipay.com"],
    "tencent": ["qq.com", "weixin.qq.com", "wechat.com"],
    "baidu": ["baidu.com"],
    "jd": ["jd.com"],
    "bank_of_china": ["boc.cn", "bankofchina.com"],
    "icbc": ["icbc.com.cn"],
    "ccb": ["ccb.com"],
    "abc": ["abchina.com"],
}


def official_sites(spark):
    rows = ", ".join(f"('{site}', '{d}')" for site, ds in OFFICIAL_SITES.items() for d in ds)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS s(site, official)")


SITES_SQL = "sites(site, official) AS (VALUES " + ", ".join(
    f"('{s}', '{d}')" for s, ds in OFFICIAL_SITES.items() for d in ds) + ")"
SITE_NAMES = list(OFFICIAL_SITES)
CLAIM_SQL = ("claims AS (SELECT page_id, list_value(" + ", ".join(f"'{s}'" for s in SITE_NAMES)
             + f")[CAST(page_id % {len(SITE_NAMES)} + 1 AS INT)] AS site, "
             "regexp_extract(url, '^https?://([^/:?#]*)', 1) AS host FROM pages)")


def site_claims(pages, spark):
    """Pages that claim to be a known site; every other one on a subdomain of that site."""
    from pyspark.sql import functions as F

    site = F.element_at(F.array(*[F.lit(s) for s in SITE_NAMES]), (F.col("page_id") % len(SITE_NAMES) + 1).cast("int"))
    host = F.regexp_extract("url", "^https?://([^/:?#]*)", 1)
    first = F.element_at(F.create_map(*[F.lit(x) for s, ds in OFFICIAL_SITES.items() for x in (s, ds[0])]), F.col("site"))
    return pages.select("page_id", site.alias("site"), host.alias("host")).select(
        "page_id", "site",
        F.when(F.col("page_id") % 2 == 0, F.concat("host", F.lit("."), first))
        .when(F.col("page_id") % 3 == 0, first)
        .when(F.col("page_id") % 5 == 0, F.concat(F.lit("evil"), first)).otherwise(F.col("host")).alias("domain"))


_FIRST_SQL = "firsts(site, first) AS (VALUES " + ", ".join(f"('{s}', '{ds[0]}')" for s, ds in OFFICIAL_SITES.items()) + ")"
CLAIMED_SQL = f"""{SITES_SQL}, {_FIRST_SQL}, {CLAIM_SQL},
claimed AS (SELECT page_id, c.site, CASE WHEN page_id % 2 = 0 THEN host || '.' || first WHEN page_id % 3 = 0 THEN first
  WHEN page_id % 5 = 0 THEN 'evil' || first ELSE host END AS domain FROM claims c JOIN firsts USING (site))"""


@query("official_domain_check", "J5", f"""WITH {CLAIMED_SQL}
SELECT page_id, site, domain, EXISTS (SELECT 1 FROM sites s WHERE s.site = c.site AND (c.domain = s.official OR ends_with(c.domain, '.' || s.official))) AS is_official FROM claimed c""")
def official_domain_check(t):
    return op.official_match(site_claims(t.pages, t.spark), official_sites(t.spark))
