"""Main text of web pages: the maximum-scoring stretch of a page's words and tags.

A page becomes a sequence of words and tags in page order. Words score +1; a tag scores the weight
learned for it, never above a small negative number: from pages that mark their article, the more
often a tag stands outside the article rather than inside, the lower. One linear scan finds the
stretch with the largest sum, and its blocks are the text.

Elements that hold no running text by their meaning (scripts, menus, footers, forms, and elements
whose class, id or role is the name of an advert, a notice or comments) are taken out of the sequence
before, so that a stretch can run across an advert in the middle of an article without containing
it. Inside an article such names leave out comments and adverts only; others lower the score of the
element's tags. An element that holds the page's article, or most words of a page without one, stays.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select")
LEFT_OUT = {"head", "nav", "footer", "aside", "form", "menu", "button", "dialog", "search", "label", "fieldset", "annotation", "annotation-xml", *RAW}
#: Of these, the ones that can hold a whole page.
CONTAINERS = {"form", "fieldset", "search", "label", "dialog"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Formulas: their words count, their tags do not.
FORMULA = {
    "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mtable", "mtr", "mtd",
    "mstyle", "mpadded", "mphantom", "menclose", "merror", "mmultiscripts", "mprescripts", "maction",
}
CLOSED_BY_BLOCK = {"p"}
# Words in class, id, role or aria-label that mark what is not the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "sidebars", "aside", "complementary", "contentinfo", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "discussion", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup",
    "login", "search", "form", "widget", "pagination", "pager", "toc", "toolbar", "skip", "copyright", "disclaimer", "legal",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies"}
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion"}
# Words that a name of marks may also hold, as in "site-footer" or "ad-slot-1".
PLACES = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "container", "wrapper", "wrap", "box", "block", "area", "list", "section", "item", "items",
    "link", "links", "bar", "slot", "unit", "panel", "buttons", "button", "icons", "thread", "id",
}
# Why an element is left out: its name, its name though it may hold a page, class or id, comments, hidden.
NAMED, CONTAINER, MARKED, COMMENT, HIDDEN = range(1, 6)
# A quote delimits a value only directly after "="; one that is never closed, or stands elsewhere, is a character.
_INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    rf"|<({'|'.join(RAW)})\b{_INSIDE}>.*?(?:</\1\s*>|$)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})(?:>|$)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?i)(?:^|[\s"'/])(class|id|role|aria-label|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"'>]|$)""")
#: The largest weight of a tag, so that a stretch never grows by tags alone.
TAG_CEILING, TAG_FLOOR = -0.02, -12.0


def _mark(attributes: str, heading: bool) -> str:
    """``hidden``, the mark that a whole class, id, role or label consists of, or nothing.

    A heading's id is the name of its section and marks nothing."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    found = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "aria-hidden" or name == "id" and heading:
            continue
        for whole in value.split() if name in ("class", "role") else [value]:
            parts = [w for w in re.split(r"[^a-z]+", whole) if w]
            marks = [w for w in parts if w in MARKS]
            if marks and all(w in MARKS or w in PLACES for w in parts):
                found = next((w for w in marks if w in COMMENTS or w in ADVERTS), found or marks[0])
    return found


def page_tokens(page: str) -> list[tuple[str, str, bool]]:
    """(kind, value, inside) in page order: kind ``tag`` with its name (``/p`` closes), or ``text``.

    ``inside`` tells whether the token lies in an ``article`` or ``main`` element. Left-out elements
    give no tokens. An element that is never closed ends with its parent, a paragraph with the next
    block. A ``header`` or ``label`` inside the article belongs to it, and an element with a mark
    there that is neither comments nor advert has the tag ``name.mark``. An element that is left out
    for its class, or a container such as a form, is taken back when the page's first article stands
    in it, or when most words of the page do and it is not beside an article; comments inside an
    article only when it has no other words.
    """
    tokens: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, str, list | None]] = []  # open elements: name, tag, left-out span
    spans: list[list] = []  # [first token, end, why, inside, holds the first article]
    named: Counter = Counter()  # open elements by name, so that a closing tag without one costs nothing
    depth = at = articles = 0

    def close(n: int) -> None:
        nonlocal depth
        while len(stack) > n:
            name, tag, span = stack.pop()
            named[name] -= 1
            if name in ("article", "main"):
                depth -= 1
            tokens.append(("tag", f"/{tag}", depth > 0))
            if span:
                span[1] = len(tokens)

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            tokens.append(("text", entities.unescape(page[at : m.start()]), depth > 0))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if not m[0].startswith("<!"):
                tokens.append(("tag", "br", depth > 0))
            continue
        if name in FORMULA:
            continue
        if m[2]:
            if not named[name]:
                continue
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if n >= 0 and not any(span and not span[4] and stack[i][0] != name for i, (_, _, span) in enumerate(stack) if i > n and name in INLINE):
                close(n)
            continue
        if name in VOID:
            tokens.append(("tag", name, depth > 0))
            continue
        if name not in INLINE and stack:
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)
            if n >= 0 and stack[n][0] in CLOSED_BY_BLOCK:
                close(n)
        if m[0].endswith("/>") and name not in ("p", "div"):
            continue
        tag, why = name, 0
        if name in LEFT_OUT and not (name == "label" and depth) or name == "header" and not depth:
            why = CONTAINER if name in CONTAINERS else NAMED
        elif name not in ("html", "body", "article", "main"):
            mark = _mark(m[4] or "", name in HEADINGS)
            if mark == "hidden":
                why = HIDDEN
            elif mark in COMMENTS:
                why = COMMENT
            elif mark and (not depth or mark in ADVERTS):
                why = MARKED
            elif mark and mark != "header":
                tag = f"{name}.{mark}"
        if name in ("article", "main"):
            if not articles:
                for _, _, span in stack:
                    if span and span[2] != NAMED:
                        span[4] = True
            articles += 1
        span = [len(tokens), 0, why, depth > 0, False] if why else None
        if span:
            spans.append(span)
        tokens.append(("tag", tag, depth > 0 or name in ("article", "main")))
        stack.append((name, tag, span))
        named[name] += 1
        depth += name in ("article", "main")
    if at < len(page):
        tokens.append(("text", entities.unescape(page[at:]), depth > 0))
    close(0)
    return _without(tokens, spans) if spans else tokens


def _without(tokens: list[tuple[str, str, bool]], spans: list[list]) -> list[tuple[str, str, bool]]:
    """The tokens outside the spans that are left out in the end."""
    shown, reached = [True] * len(tokens), 0
    for start, end, why, _, holds in spans:
        if why == NAMED or why == HIDDEN and not holds:
            shown[max(start, reached) : end] = [False] * max(0, end - max(start, reached))
            reached = max(reached, end)
    words, of_article = [0], 0
    for (kind, value, inside), seen in zip(tokens, shown):
        n = len(value.split()) if seen and kind == "text" else 0
        words.append(words[-1] + n)
        of_article += n if inside else 0
    reached = 0
    for start, end, why, inside, holds in spans:
        own = words[end] - words[start]
        most = 2 * own > words[-1] and (inside or not of_article)
        if why == COMMENT and inside:
            most = own and own == of_article
        if why in (CONTAINER, MARKED, COMMENT) and not holds and not most and end > reached:
            shown[max(start, reached) : end] = [False] * (end - max(start, reached))
            reached = end
    return [t for t, seen in zip(tokens, shown) if seen]


def tag_weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """The weight of each tag: minus one, plus the log-odds of standing inside the article."""
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    weights = {}
    for tag in inside.keys() | outside.keys():
        odds = math.log((inside[tag] + 0.5) / n_in) - math.log((outside[tag] + 0.5) / n_out)
        weights[tag] = max(TAG_FLOOR, min(TAG_CEILING, odds - 1.0))
    return weights


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """[start, end) with the largest sum, found in one pass; the first and longest of equal ones."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and start == where[0]:
            best, where = total, (start, i + 1)
    return where


def blocks_of(tokens: list[tuple[str, str, bool]]) -> str:
    """Texts between block tags, white space turned into one space, non-empty ones joined by \\n."""
    blocks, held = [], []
    for kind, value, _ in tokens:
        if kind == "text":
            held.append(value)
        elif value == "br":
            held.append(" ")
        elif value.lstrip("/").partition(".")[0] not in INLINE:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def tag_score(tag: str, weights: dict[str, float], unknown: float) -> float:
    """The weight learned for the tag; a mark that was not seen costs one more than the tag without it."""
    bare, _, mark = tag.partition(".")
    return weights.get(tag, weights.get(bare, unknown) - 1.0 if mark else unknown)


def main_text(page: str, weights: dict[str, float], unknown: float = -1.0) -> str:
    """The text of the page's best stretch; empty if it has no words outside left-out elements."""
    tokens = page_tokens(page)
    scores = [float(len(v.split())) if k == "text" else tag_score(v, weights, unknown) for k, v, _ in tokens]
    start, end = best_stretch(scores)
    return blocks_of(tokens[start:end])


def learn_weights(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = 2_000) -> dict[str, float]:
    """Tag weights from labelled pages: those that mark their article with an ``article`` element.

    Pages whose hash falls below ``sample_pages`` / number of pages are used, so about that many or
    fewer, wherever they lie. That bounds the fit; tags are counted in Spark, and one row per tag
    name reaches the driver.
    """
    total = max(1, pages.count())
    hashed = pages.select(F.col(html).alias("html"), F.xxhash64(F.lit(7), page_id, html).alias("h"))
    chosen = F.pmod("h", F.lit(1 << 40)) < F.lit(min(1 << 40, (sample_pages << 40) // total))
    sample = hashed.where(chosen & F.col("html").rlike(r"(?i)<article[\s>]")).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                seen.update((v, i) for k, v, i in page_tokens(page) if k == "tag")
        yield pa.RecordBatch.from_pydict({"tag": [k[0] for k in seen], "inside": [k[1] for k in seen], "n": list(seen.values())}, schema=pa.schema([("tag", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    counted = sample.mapInArrow(count, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n")).collect()
    inside, outside = Counter(), Counter()
    for r in counted:
        (inside if r["inside"] else outside)[r["tag"]] += r["n"]
    return tag_weights(inside, outside)


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) per page; ``weights`` are learned from it by default.

    A null page, and one without words outside left-out elements, has empty text. Repeated rows give
    repeated rows; other columns are not read. Without labelled pages every tag weighs -1.
    """
    weights = learn_weights(pages, html, page_id) if weights is None else weights
    picked = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                texts = [main_text(x or "", weights) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
