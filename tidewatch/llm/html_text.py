"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut at its block tags into flat blocks of text. A block is described by its word
count and link density, those of the blocks before and after it, and by where it stands: in the
page's main element or beside it, inside an element for menus, forms, adverts, notices or
comments, and whether it is a heading. A small decision tree, grown here from a short labelled
table, keeps or drops it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "chrome", "heading")

#: Labelled blocks: the features above and whether the block belongs to the main text. ``links``
#: are shares of words; ``main`` is 1 in the main element, 0 beside it, 0.5 on pages without one.
LABELLED = np.array([
    # in the main element: paragraphs, headings, short lines, paragraphs with links
    (60, 0.00, 8, 0.0, 55, 0.0, 1, 0, 0, 1), (8, 0.00, 12, 0.2, 60, 0.0, 1, 0, 1, 1), (1, 0.00, 40, 0.0, 30, 0.0, 1, 0, 0, 1),
    (3, 0.00, 5, 0.0, 4, 0.0, 1, 0, 0, 1), (25, 0.30, 50, 0.0, 40, 0.1, 1, 0, 0, 1), (12, 1.00, 40, 0.0, 35, 0.0, 1, 0, 0, 1),
    (2, 1.00, 20, 0.1, 25, 0.0, 1, 0, 0, 1), (40, 0.05, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (5, 0.00, 0, 0.0, 0, 0.0, 1, 0, 1, 1),
    (120, 0.00, 90, 0.0, 20, 0.6, 1, 0, 0, 1), (6, 0.00, 6, 1.0, 7, 1.0, 1, 0, 0, 1), (15, 0.50, 3, 1.0, 4, 1.0, 1, 0, 0, 1),
    # in an element for menus and the like, wherever it stands
    (4, 1.00, 3, 1.0, 4, 1.0, 1, 1, 0, 0), (30, 0.00, 60, 0.0, 50, 0.0, 1, 1, 0, 0), (9, 0.00, 30, 0.0, 8, 0.0, 1, 1, 1, 0),
    (55, 0.10, 70, 0.0, 60, 0.0, 1, 1, 0, 0), (2, 1.00, 2, 1.0, 2, 1.0, 0, 1, 0, 0), (12, 0.00, 2, 1.0, 8, 0.0, 0, 1, 0, 0),
    (80, 0.00, 60, 0.0, 75, 0.0, 0, 1, 0, 0), (20, 0.00, 40, 0.0, 0, 0.0, 0, 1, 0, 0), (1, 1.00, 1, 1.0, 1, 1.0, 0.5, 1, 0, 0),
    (90, 0.00, 45, 0.0, 60, 0.0, 0.5, 1, 0, 0), (14, 0.10, 60, 0.0, 0, 0.0, 0.5, 1, 0, 0), (6, 0.00, 70, 0.0, 20, 0.0, 0.5, 1, 1, 0),
    (40, 0.00, 20, 0.0, 30, 0.0, 0.5, 1, 0, 0), (3, 0.00, 50, 0.0, 45, 0.0, 0.5, 1, 0, 0),
    # beside the main element
    (30, 0.00, 10, 0.0, 25, 0.0, 0, 0, 0, 0), (5, 0.00, 12, 0.0, 60, 0.0, 0, 0, 1, 0), (60, 0.00, 80, 0.0, 0, 0.0, 0, 0, 0, 0),
    (25, 0.00, 60, 0.0, 2, 0.0, 0, 0, 0, 0), (12, 0.00, 20, 0.0, 4, 1.0, 0, 0, 0, 0), (70, 0.10, 0, 0.0, 0, 0.0, 0, 0, 0, 0),
    (3, 1.00, 3, 1.0, 4, 1.0, 0, 0, 0, 0), (8, 0.50, 40, 0.0, 3, 1.0, 0, 0, 0, 0), (100, 0.00, 90, 0.0, 95, 0.0, 0, 0, 0, 0),
    # pages without a main element: long blocks, and short ones between long ones
    (60, 0.00, 8, 0.0, 55, 0.0, 0.5, 0, 0, 1), (35, 0.10, 40, 0.0, 20, 0.3, 0.5, 0, 0, 1), (80, 0.00, 3, 1.0, 3, 1.0, 0.5, 0, 0, 1),
    (25, 0.00, 0, 0.0, 30, 0.0, 0.5, 0, 0, 1), (18, 0.00, 45, 0.0, 50, 0.0, 0.5, 0, 0, 1), (9, 0.00, 40, 0.0, 60, 0.0, 0.5, 0, 0, 1),
    (4, 0.00, 55, 0.0, 40, 0.0, 0.5, 0, 0, 1), (7, 0.00, 5, 1.0, 60, 0.0, 0.5, 0, 1, 1), (5, 0.00, 50, 0.0, 45, 0.0, 0.5, 0, 1, 1),
    (40, 0.25, 30, 0.0, 35, 0.2, 0.5, 0, 0, 1), (12, 0.00, 35, 0.1, 28, 0.0, 0.5, 0, 0, 1), (50, 0.00, 0, 0.0, 0, 0.0, 0.5, 0, 0, 1),
    (22, 0.00, 12, 0.0, 14, 0.0, 0.5, 0, 0, 1), (16, 0.20, 40, 0.0, 33, 0.0, 0.5, 0, 0, 1), (10, 0.00, 30, 0.0, 2, 0.0, 0.5, 0, 0, 1),
    (30, 0.00, 4, 1.0, 8, 0.0, 0.5, 0, 0, 1), (6, 0.00, 22, 0.0, 26, 0.1, 0.5, 0, 0, 1), (3, 0.00, 2, 1.0, 80, 0.0, 0.5, 0, 1, 1),
    (40, 0.00, 70, 0.0, 0, 0.0, 0.5, 0, 0, 1), (60, 0.00, 120, 0.0, 3, 1.0, 0.5, 0, 0, 1), (25, 0.00, 90, 0.0, 5, 0.0, 0.5, 0, 0, 1),
    (14, 0.00, 60, 0.0, 0, 0.0, 0.5, 0, 0, 1), (5, 0.00, 80, 0.0, 0, 0.0, 0.5, 0, 0, 1), (70, 0.30, 65, 0.1, 0, 0.0, 0.5, 0, 0, 1),
    # pages without a main element: link lists, lone short lines, lines at the page's ends
    (2, 1.00, 2, 1.0, 2, 1.0, 0.5, 0, 0, 0), (3, 1.00, 0, 0.0, 2, 1.0, 0.5, 0, 0, 0), (4, 1.00, 3, 1.0, 60, 0.0, 0.5, 0, 0, 0),
    (20, 0.90, 5, 1.0, 4, 1.0, 0.5, 0, 0, 0), (12, 0.80, 40, 0.0, 6, 1.0, 0.5, 0, 0, 0), (5, 0.00, 3, 1.0, 4, 1.0, 0.5, 0, 0, 0),
    (3, 0.00, 0, 0.0, 3, 1.0, 0.5, 0, 0, 0), (6, 0.00, 4, 1.0, 0, 0.0, 0.5, 0, 0, 0), (8, 0.40, 5, 0.8, 3, 1.0, 0.5, 0, 0, 0),
    (30, 0.70, 20, 0.9, 25, 0.8, 0.5, 0, 0, 0), (2, 0.00, 3, 0.5, 2, 0.0, 0.5, 0, 0, 0), (4, 0.50, 6, 0.0, 5, 0.6, 0.5, 0, 0, 0),
    (7, 0.00, 8, 0.7, 5, 0.9, 0.5, 0, 0, 0), (1, 0.00, 1, 0.0, 1, 0.0, 0.5, 0, 0, 0), (15, 1.00, 60, 0.0, 50, 0.0, 0.5, 0, 0, 0),
])

#: Elements whose content is never shown as text, and those that end a block.
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select",
          "title", "button", "datalist", "xmp")
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
CLOSED_BY_NEXT = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", *HEADINGS))
MAIN = frozenset(("article", "main"))
CHROME = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "head", "legend"))
#: Names in class, id and role of elements for menus, adverts, notices and comments.
CHROME_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side rail menu nav navbar
navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended recommendations trending popular
comment comments commentlist disqus reply replies respond discussion feedback widget pagination pager legal copyright disclaimer login search
skip complementary contentinfo search dialog hidden paywall""".split())
#: Of these, names that running text has as well: on elements of text they tell nothing, and an id of a section or heading names its topic.
WEAK_NAMES = frozenset("""discussion related recommended social search share sharing legal popular trending feedback side notice notices notification alert
reply replies respond overlay skip copyright disclaimer banner promo rail widget hidden""".split())
OF_TEXT = frozenset(("section", "blockquote", "p", "figure", "li", "pre", "table", *HEADINGS))
#: Words that may stand beside such a name in one class token; with any other word the token names something else.
PLAIN_PARTS = frozenset("""site main page top bottom left right list lists box block section container wrapper wrap area bar item items link links button
buttons text content post posts article articles header form panel inner outer global primary secondary module col column row group user
reader story stories news follow us sticky fixed mobile desktop inline slot unit label title wide small large""".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join(HIDDEN) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>])[^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
INVISIBLE = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\b(?!\s*[=-])|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: (feature, threshold, below, above) or a label."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, k] < cut
            a, b = labels[low], labels[~low]
            cost = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, float(cut), low)
    if best is None:
        return bool(share >= 0.5)
    _, k, cut, low = best
    return k, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def decide(tree, row) -> bool:
    while not isinstance(tree, bool):
        k, cut, below, above = tree
        tree = below if row[k] < cut else above
    return tree


def _names_chrome(token: str) -> bool:
    """Whether a whole class token names an element beside the text: one of the names, or one among words that say nothing else."""
    parts = [x for x in re.split(r"[^a-z]+", token.lower()) if x]
    names = CHROME_NAMES.intersection(parts)
    more = ("privacy", "policy") if names - WEAK_NAMES else ()
    return bool(names) and all(x in CHROME_NAMES or x in PLAIN_PARTS or x in more for x in parts)


def _is_chrome(name: str, attributes: str, in_main: bool = False) -> bool:
    """Whether an element's attributes hide it or name it one for menus, adverts, notices and the like.

    In the main element the ids of sections and headings are names of topics, unless they name the reader comments.
    """
    if not attributes:
        return False
    if INVISIBLE.search(re.sub(r"""(?:class|id|href|title|alt)\s*=\s*(?:"[^"]*"|'[^']*')""", "", attributes)):
        return True
    if name in ("html", "body", "main"):
        return False
    for m in NAMES.finditer(attributes):
        kind, *values = m.groups("")
        tokens = [x for x in "".join(values).split() if _names_chrome(x)]
        if in_main and name in OF_TEXT:
            tokens = [x for x in tokens if x.lower() not in WEAK_NAMES and not (kind.lower() == "id" and name in HEADINGS)]
        if tokens:
            return True
    return False


class Block:
    __slots__ = ("text", "words", "links", "main", "chrome", "heading")

    def __init__(self, text: str, words: int, links: float, main: float, chrome: int, heading: int):
        self.text, self.words, self.links, self.main, self.chrome, self.heading = text, words, links, main, chrome, heading


def flat_blocks(page: str) -> list[Block]:
    """Text blocks in page order. Unclosed elements end with their parent or their next like."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome by tag, chrome by its names
    pieces: list[str] = []
    linked = 0  # words inside links
    in_link = False

    def shown(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.split())

    def end_block() -> None:
        nonlocal linked
        words = "".join(pieces).split()
        pieces.clear()
        if words:
            main = [i for i, x in enumerate(stack) if x[0] in MAIN and not x[2]]
            inner = stack[main[-1]:] if main else stack
            # a form around the main element is the page's, not one inside the text
            chrome = any(x[1] and not (main and x[0] in ("form", "fieldset") and i < main[0]) for i, x in enumerate(stack)) or any(x[2] for x in (inner if main else stack))
            heading = any(x[0] in HEADINGS for x in stack)
            if any(x[0] == "header" for x in stack) and not (main and heading):
                chrome = True
            out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), float(bool(main)), int(chrome), int(heading)))
        linked = 0

    at = 0
    for m in TAG.finditer(page):
        shown(page[at:m.start()])
        at = m.end()
        name = m.group(3) or m.group(6)
        if name is None:
            continue
        name = name.lower()
        if m.group(2) or m.group(5):
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                end_block()
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if k is not None:
                    del stack[k:]
            else:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] in BLOCKS), None)
                if k is not None and stack[k][0] == name:
                    end_block()
                    del stack[k:]
            continue
        attributes = m.group(4) or ""  # none of a tag with an unclosed quote
        in_main = any(x[0] in MAIN and not x[2] for x in stack)
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = True
        elif name in BLOCKS:
            end_block()
            in_link = False
            if name == "hr":
                continue
            while stack and stack[-1][0] == "p":
                stack.pop()
            if name in CLOSED_BY_NEXT and stack and (stack[-1][0] == name or name in ("dt", "dd") and stack[-1][0] in ("dt", "dd")):
                stack.pop()
            stack.append((name, name in CHROME, _is_chrome(name, attributes, in_main)))
        elif attributes and not attributes.endswith("/") and _is_chrome(name, attributes, in_main) and name not in ("img", "input", "link", "meta", "source", "wbr"):
            end_block()
            stack.append((name, False, True))
    shown(page[at:])
    end_block()
    if not any(b.main for b in out):
        for b in out:
            b.main = 0.5
    return out


def main_text(page: str | None, tree) -> str:
    """Kept blocks joined by an empty line; empty for null, empty and text-free pages."""
    blocks = flat_blocks(page or "")
    kept = []
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        row = (b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0,
               b.main, b.chrome, b.heading)
        if decide(tree, row):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, labelled: np.ndarray = LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text and its number of code points.

    ``labelled`` has the columns of ``FEATURES`` and the label. A null or empty page, and one
    without a kept block, has an empty text. White space inside a block becomes one blank;
    character references are decoded. Repeated rows stay repeated, further columns are not
    read, an empty table gives an empty result; pages of any length are read whole.
    """
    tree = grow(labelled[:, :-1], labelled[:, -1])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                              names=["page_id", "url", "text", "n_chars"])
        return step

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_texts(rows, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", make)
