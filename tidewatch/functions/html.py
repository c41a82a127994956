"""Page markup as column expressions.

Tags are cut out with regular expressions on the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.url import domain_of, netloc
from tidewatch.runtime import spread

# --- fixed values: elements that carry no visible text --------------------------------
HIDDEN_CONTAINERS = ["script", "style", "noscript", "header", "footer", "nav", "aside"]
HIDDEN_VOID = ["meta", "link"]

#: Characters of named references, from the standard library's table; a no-break space counts as a blank.
NAMED = json.dumps({name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "})
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31})(;?)"
ATTRS = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed, and held in the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decoded(piece: Column) -> Column:
    """What follows an ampersand, with the reference that it may begin with decoded."""
    def character(found: Column) -> Column:
        digits = F.when(found.rlike("^#[xX]"), F.conv(F.substring(found, 3, 6), 16, 10)).when(found.startswith("#"), F.substring(found, 2, 7))
        number = let(digits.cast("bigint"), lambda code: F.when(
            code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNotNull(), "\ufffd"))
        named = F.try_element_at(F.from_json(F.lit(NAMED), "map<string,string>"), F.nullif(found, F.lit("")))
        end = F.length(found) + F.length(F.regexp_extract(piece, REFERENCE, 2)) + 1
        return F.concat(F.coalesce(number, named), piece.substr(end, F.length(piece)))

    return F.coalesce(let(F.regexp_extract(piece, REFERENCE, 1), character), F.concat(F.lit("&"), piece))


def unescape(text: Column) -> Column:
    """Text with named and numeric character references decoded, each once; others stay as they are."""
    def whole(pieces: Column) -> Column:
        rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(rest, _decoded), ""))

    return let(F.split(text, "&"), whole)


def without_elements(html: Column, tag: str) -> Column:
    """The page without the elements ``tag`` and all inside, nested ones included.

    An element that is not closed is left where it is.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.rlike(f"(?is)^<{tag}\\b"), piece.rlike(f"(?is)^</{tag}\\b") & (state["depth"] > 0)
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        shown = F.when(closes, F.concat(F.lit(" "), F.regexp_replace(piece, "(?s)^[^>]*>?", ""))).otherwise(piece)
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(state["kept"], shown)).otherwise(state["kept"]).alias("kept"))

    plain = f"(?is)<{tag}\\b{ATTRS}>.*?</{tag}\\s*>"
    return let(html, lambda page: let(F.aggregate(F.split(page, f"(?i)(?=</?{tag}\\b)"), start, step), lambda done: F.when(
        done["depth"] == 0, done["kept"]).otherwise(F.regexp_replace(page, plain, " "))))


def tidy(text: Column) -> Column:
    """Collapse white space, drop control characters, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), CONTROL, ""))


def markup(html: Column) -> Column:
    """The page without comments and without the raw text of scripts and styles."""
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        bare = F.regexp_replace(bare, f"(?is)(<{tag}\\b{ATTRS}>).*?</{tag}\\s*>", "$1")
    return bare


def tags(clean: Column, *names: str) -> Column:
    """Opening tags with one of the names, in page order."""
    return F.regexp_extract_all(clean, F.lit(f"(?is)<(?:{'|'.join(names)})\\b{ATTRS}>"), F.lit(0))


def tag_names(clean: Column) -> Column:
    """Lower-case names of all opening tags, in page order."""
    return F.transform(F.regexp_extract_all(clean, F.lit(f"(?s)<([a-zA-Z][a-zA-Z0-9]*){ATTRS}>"), F.lit(1)), F.lower)


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute, '' when it has none."""
    pattern = f"""(?is)\\s{name}\\s*=\\s*(?:"([^"]*)"|'([^']*)'|([^\\s>"']+))"""
    return unescape(F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(f"(?is)\\s{name}[\\s=>/]")


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def is_web(link: Column) -> Column:
    return link.rlike("^https?://")


def with_markup(df: DataFrame, html: str = "html") -> DataFrame:
    """Add the link and form arrays that the page rules read; null pages give nulls."""
    clean = F.col("_clean")
    return (
        df.withColumn("_clean", markup(F.col(html)))
        .withColumn("anchors", F.transform(F.filter(tags(clean, "a"), lambda t: has_attr(t, "href")), lambda t: attr(t, "href")))
        .withColumn("anchor_tags", F.size(tags(clean, "a")))
        .withColumn("resources", F.array_compact(F.transform(tags(clean, "img", "script", "link"), lambda t: first_filled(attr(t, "src"), attr(t, "href")))))
        .withColumn("references", F.array_compact(F.transform(tags(clean, "meta", "script", "link"), lambda t: first_filled(attr(t, "src"), attr(t, "href"), attr(t, "content")))))
        .withColumn("icons", F.transform(F.filter(tags(clean, "link"), lambda t: F.lower(attr(t, "rel")).contains("icon")), lambda t: attr(t, "href")))
        .withColumn("actions", F.transform(F.filter(tags(clean, "form"), lambda t: has_attr(t, "action")), lambda t: attr(t, "action")))
        .withColumn("iframes", F.size(tags(clean, "iframe")))
    )


def foreign(link: Column, domain: Column) -> Column:
    """An absolute link whose domain does not contain ours."""
    return is_web(link) & ~domain_of(link).contains(domain)


def share_flag(part: Column, total: Column, low: int, high: int) -> Column:
    percent = F.try_divide(part * F.lit(100.0), total)
    return F.when(total == 0, 1).when(percent < low, 1).when(percent <= high, 0).otherwise(-1)


def page_features(html: str = "html") -> dict[str, Column]:
    """Features of the page; input columns come from ``with_markup`` and ``url.parse``."""
    page, d = F.col(html), F.col("domain")
    low = F.lower(page)
    icon = F.get("icons", F.lit(0))
    icon_domain = domain_of(icon)
    icon_ok = (icon.startswith("/") & ~icon.startswith("//")) | icon_domain.contains(d) | d.contains(icon_domain)
    dead = F.lit(["#", "", "javascript:void(0)", "javascript:;"])
    bad_anchor = F.size(F.filter("anchors", lambda a: F.array_contains(dead, a) | foreign(a, d)))
    web_refs = F.filter("references", is_web)
    # the first form that decides: an empty action or a foreign one
    verdict = F.get(F.filter("actions", lambda a: a.isin("", "about:blank") | foreign(a, d)), F.lit(0))
    sfh = F.when(verdict.isNull(), 1).when(verdict.isin("", "about:blank"), 0).otherwise(-1)

    def needs_page(value: Column) -> Column:
        return F.when(page.isNull() | (page == ""), -1).otherwise(value)

    def clean_without_page(bad: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), -1).otherwise(1)

    return {
        "Favicon": needs_page(F.when((F.coalesce(icon, F.lit("")) != "") & icon_ok, 1).otherwise(-1)),
        "Request_URL": needs_page(share_flag(F.size(F.filter("resources", lambda r: foreign(r, d))), F.size("resources"), 22, 61)),
        "URL_of_Anchor": needs_page(share_flag(bad_anchor, F.size("anchors"), 31, 67)),
        "Links_in_tags": needs_page(share_flag(F.size(F.filter(web_refs, lambda r: ~domain_of(r).contains(d))), F.size(web_refs), 17, 81)),
        "SFH": needs_page(sfh),
        "Submitting_to_email": clean_without_page(page.contains("mailto:") | page.contains("mail(")),
        "on_mouseover": clean_without_page(low.contains("onmouseover")),
        "RightClick": clean_without_page(low.contains("event.button==2") | low.contains("oncontextmenu")),
        "popUpWidnow": clean_without_page(low.contains("window.open") | low.contains("alert(")),
        "Iframe": clean_without_page(F.col("iframes") > 0),
        "Links_pointing_to_page": needs_page(F.when(F.col("anchor_tags") > 50, 1).when(F.col("anchor_tags") > 10, 0).otherwise(-1)),
    }


def title(html: Column) -> Column:
    return tidy(unescape(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def meta_description(clean: Column) -> Column:
    named = F.filter(tags(clean, "meta"), lambda t: attr(t, "name") == "description")
    return tidy(F.coalesce(attr(F.get(named, F.lit(0)), "content"), F.lit("")))


def visible_text(html: Column) -> Column:
    """Text of the body without the hidden elements."""
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in HIDDEN_CONTAINERS[:3]:  # raw text cannot nest
        bare = F.regexp_replace(bare, f"(?is)<{tag}\\b{ATTRS}>.*?</{tag}\\s*>", " ")
    for tag in HIDDEN_CONTAINERS[3:]:
        bare = without_elements(bare, tag)
    body = F.regexp_extract(bare, "(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|\\z)", 1)
    inner = F.when(bare.rlike("(?i)<body\\b"), body).otherwise(bare)
    return tidy(unescape(F.regexp_replace(inner, "<[^>]*>", " ")))


def forms(clean: Column) -> Column:
    """Forms in page order: action, upper-case method, inputs (type, name, placeholder)."""
    whole = F.regexp_extract_all(clean, F.lit("(?is)<form\\b.*?(?:</form\\s*>|\\z)"), F.lit(0))

    def one(text: Column) -> Column:
        head = F.get(tags(text, "form"), F.lit(0))
        return F.struct(
            attr(head, "action").alias("action"),
            F.upper(F.coalesce(F.nullif(attr(head, "method"), F.lit("")), F.lit("get"))).alias("method"),
            F.transform(tags(text, "input"), lambda i: F.struct(
                F.when(has_attr(i, "type"), attr(i, "type")).otherwise("text").alias("type"),
                attr(i, "name").alias("name"), attr(i, "placeholder").alias("placeholder"),
            )).alias("inputs"),
        )

    return F.transform(whole, one)


def link_counts(anchors: Column, base: Column) -> Column:
    """Internal and external links; script, mail and fragment links do not count."""
    real = F.filter(anchors, lambda a: ~a.rlike("^(javascript:|mailto:|#)"))
    inside = F.size(F.filter(real, lambda a: netloc(a).isin("") | (netloc(a) == base)))
    return F.struct(inside.alias("internal"), (F.size(real) - inside).alias("external"), F.size(real).alias("total"))


def has_password(form_list: Column) -> Column:
    return F.exists(form_list, lambda f: F.exists(f["inputs"], lambda i: i["type"] == "password"))


def page_content(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Title, description, text, forms, link counts and login flags of every page."""
    from tidewatch.functions.url import normalize

    return (
        with_markup(spread(df), html)
        .withColumn("title", title(F.col(html)))
        .withColumn("description", meta_description(F.col("_clean")))
        .withColumn("text", visible_text(F.col(html)))
        .withColumn("text_length", F.length("text"))
        .withColumn("forms", forms(F.col("_clean")))
        .withColumn("links", link_counts(F.col("anchors"), netloc(normalize(F.col(url)))))
        .withColumn("has_password_field", has_password(F.col("forms")))
        .withColumn("has_login_form", F.col("has_password_field"))
        .drop("_clean", "anchors", "anchor_tags", "resources", "references", "icons", "actions", "iframes")
    )


def model_text(title_: Column, description: Column, text: Column, max_length: int | None = 512) -> Column:
    """Title, description and text in one string; ``None`` keeps the whole text."""
    joined = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title_, description, text)])
    return F.substring(joined, 1, max_length) if max_length else joined
