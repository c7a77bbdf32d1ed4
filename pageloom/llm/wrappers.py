"""Operator 7: main text of pages by inferred wrappers.

A page is read as a tree of block elements with text slots. Pages of one host share
a wrapper, a union-free regular expression over such trees: neighbouring elements
of one kind become a repeated group, and what one page has and another lacks becomes
optional when the two are aligned. Wrappers are merged like that, first the distinct
ones of a host in parts, then the results, until every host has one.

Each text slot of the wrapper is the article's, other content, or furniture (by the
elements, roles and names on its path). The text of a page is that of its article slots; of
pages without any, that of the other content.

Null html gives an empty text; a null or odd url belongs to the host ``''``. Repeated
rows give repeated results.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import add_columns, skew_join
from pageloom.session import materialize

PART = 64  # wrappers that one group merges
BROADCAST_BYTES = 32 << 20  # wrappers of all hosts up to this size go to every executor
LONGEST_GROUP = 4
MARKS = "!^~"

# Elements of HTML by what they do to the text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp", "nobr",
}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
FURNITURE = {
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "script", "style", "textarea", "title", "iframe", "noscript", "template",
    "button", "select", "option", "optgroup", "datalist", "svg", "canvas", "object", "audio", "video", "map", "noembed", "noframes",
    "xmp", "fieldset", "header",
}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related",
    "recommended", "comment", "comments", "disqus", "replies", "toolbar", "pagination", "pager", "widget", "skiplink",
}
HEADER_NAMES = {"header", "site-header", "page-header", "siteheader", "pageheader", "topbar"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {  # an open element that ends where one of these begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
LISTS = {"ul", "ol", "dl", "table", "select", "menu"}  # where such an end is not looked for any further out

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=20_000)
def _label(name: str, attributes: str) -> str:
    """The element with the marks that tell furniture: ``div``, ``div!`` (furniture), ``div~`` (outside articles), ``div^`` (article).

    A role or a whole class or id tells furniture everywhere, a part of a name only outside
    articles. Ids of headings and paragraphs are often made from their text and tell nothing.
    """
    if not attributes.strip():
        return name
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
    classes = found.get("class", "")
    if name not in HEADINGS | {"p"}:
        classes = f"{classes} {found.get('id', '')}"
    names = [{n for n in re.split(r"[-_]+", _CAMEL.sub("-", c).lower()) if n} for c in classes.split()]
    role = found.get("role", "").lower()
    whole = {c.lower() for c in classes.split()}
    # A name of furniture names only, such as ad-banner, is one as a whole.
    if role in FURNITURE_ROLES or any(n and n <= FURNITURE_NAMES for n in names) or HEADER_NAMES & whole:
        return name if name in ARTICLE | {"body", "html"} else f"{name}!"
    if role == "main" or found.get("itemprop", "").lower() == "articlebody":
        return f"{name}^"
    if any(n & FURNITURE_NAMES for n in names) and name not in ARTICLE | {"body", "html"}:
        return f"{name}~"
    return name


def read_page(page: str) -> tuple[list, list[tuple[tuple[str, ...], str]]]:
    """The tree of block elements ``[label, children]`` and the text blocks ``(path, text)`` in order.

    A block's path ends with ``#``, or ``#a`` if all of its text is in links.
    """
    root: list = ["", []]
    stack, inline = [root], 0  # inline: depth of links
    blocks: list[tuple[tuple[str, ...], str]] = []
    texts: list[str] = []
    linked = [True]

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(texts)).strip()
        texts.clear()
        if text:
            slot = "#a" if linked[0] else "#"
            blocks.append((tuple(node[0] for node in stack[1:]) + (slot,), text))
            stack[-1][1].append([slot, []])
        linked[0] = True

    def put(text: str) -> None:
        if text:
            texts.append(html.unescape(text))
            if not inline and text.strip():
                linked[0] = False

    def close(i: int) -> None:
        flush()
        del stack[i:]

    at = 0
    for match in iter(lambda: _TOKEN.search(page, at), None):
        put(page[at : match.start()])
        at = match.end()
        if match[2] is not None:
            end, name, attributes = match[1], match[2].lower(), match[3]
        elif match[5] is not None:
            end, name, attributes = match[4], match[5].lower(), match[6]
        else:
            if match[0].startswith("<![CDATA["):
                put(match[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if name in ("br", "hr") or (name in VOID and name not in INLINE):
            if name == "br":
                texts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in RAW and not end:
            flush()
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
            body = page[at : stop.start() if stop else len(page)]
            stack[-1][1].append([name, [["#", []]] if body.strip() else []])
            at = len(page) if not stop else (page.find(">", stop.start()) + 1 or len(page))
            continue
        if name in INLINE:
            if name == "a":
                inline = 0 if end else 1
            continue
        label = name if end else _label(name, attributes)
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0].rstrip(MARKS) == name:
                    close(i)
                    break
            else:
                flush()
            continue
        flush()
        inline = 0
        if stack[-1][0].rstrip(MARKS) in ("p", *HEADINGS) and (name not in HEADINGS or stack[-1][0].rstrip(MARKS) in ("p", *HEADINGS)):
            stack.pop()  # these hold no blocks
        if name in CLOSES or name in ("dt", "dd"):
            for i in range(len(stack) - 1, 0, -1):
                inner = stack[i][0].rstrip(MARKS)
                if inner in LISTS:
                    break
                if name in CLOSES.get(inner, ()):
                    del stack[i:]
                    break
        node = [label, []]
        stack[-1][1].append(node)
        if not attributes.rstrip().endswith("/"):
            stack.append(node)
    put(page[at:])
    flush()
    return root, blocks


# A wrapper node is [label, children, least, most]: how often it comes, most 2 standing for any number.


def _merged(a: list, b: list) -> list:
    """What matches both of two nodes of one label."""
    return [a[0], align(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])]


def _optional(node: list) -> list:
    return [node[0], node[1], 0, node[3]]


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [x[0] for x in a[1]] == [x[0] for x in b[1]])


def fold(nodes: list) -> list:
    """Neighbours of one kind, and neighbouring groups of kinds, become one repeated node."""
    out: list = []
    for node in nodes:
        out.append(node)
        if len(out) > 1 and _same(out[-1], out[-2]):
            b, a = out.pop(), out.pop()
            out.append([a[0], align(a[1], b[1]), 1 if a[2] + b[2] else 0, 2])
    for size in range(2, LONGEST_GROUP + 1):
        i, again = 0, []
        while i < len(out):
            unit, j = out[i : i + size], i + size
            while len(unit) == size and len(out) >= j + size and all(map(_same, unit, out[j : j + size])):
                unit = [_merged(x, y) for x, y in zip(unit, out[j : j + size], strict=True)]
                j += size
            if j > i + size:
                again.append(["()", unit, 1, 2])
                i = j
            else:
                again.append(out[i])
                i += 1
        out = again
    return out


def as_wrapper(node: list) -> list:
    """The wrapper of one page."""
    return [node[0], fold([as_wrapper(child) for child in node[1]]), 1, 1]


def align(a: list, b: list) -> list:
    """Two lists of children in one: a longest common subsequence is merged, the rest is optional."""
    if a == b:
        return a
    n, m = len(a), len(b)
    length = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            length[i][j] = length[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if _same(a[i], b[j]):
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif length[i + 1][j] >= length[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return fold([*out, *map(_optional, a[i:]), *map(_optional, b[j:])])


def expression(node: list) -> str:
    """A wrapper as a regular expression over tags, for people."""
    inner = "".join(map(expression, node[1]))
    body = inner if node[0] in ("", "()") else f"<{node[0]}>{inner}</>" if node[0][0] != "#" else node[0]
    return f"({body})" + {(0, 1): "?", (1, 2): "+", (0, 2): "*"}[node[2], node[3]] if (node[2], node[3]) != (1, 1) else body


def slot_kind(path: tuple[str, ...]) -> int:
    """2: in an article; 1: other content; 0: furniture."""
    inside = False
    for label in path:
        name = label.rstrip(MARKS)
        if label.endswith("!") or label.endswith("~") and not inside:
            return 0
        if name in FURNITURE and not (name == "header" and inside and path[-2].rstrip(MARKS) in HEADINGS):
            return 0
        inside = inside or name in ARTICLE or label.endswith("^")
    if inside:
        return 2
    return 0 if path[-1] == "#a" else 1


@lru_cache(maxsize=2_000)
def slots(wrapper: str) -> dict[tuple[str, ...], int]:
    """The text slots of a wrapper and their kinds."""
    found: dict[tuple[str, ...], int] = {}

    def walk(node: list, path: tuple[str, ...]) -> None:
        for child in node[1]:
            own = path if child[0] == "()" else (*path, child[0])
            if child[0][:1] == "#":
                found[own] = slot_kind(own)
            walk(child, own)

    walk(json.loads(wrapper), ())
    return found


def main_text(page: str | None, wrapper: str) -> str:
    kinds = slots(wrapper)
    blocks = [(kinds[path], text) for path, text in read_page(page or "")[1]]
    best = max((kind for kind, _ in blocks), default=0)
    return "\n".join(text for kind, text in blocks if kind == best and best > 0)


def _dump(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def host_of(url: str | None) -> str:
    try:
        return urlsplit((url or "").strip()).hostname or ""
    except ValueError:
        return ""


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of ``(url, html)``, stored."""

    def start():
        one = lambda page: _dump(as_wrapper(read_page(page or "")[0]))
        return lambda urls, found: ([host_of(u) for u in urls], [one(page) for page in found])

    made = add_columns(pages.select("url", "html"), ["url", "html"], "host string, wrapper string", start)
    left = materialize(made.select("host", "wrapper").distinct(), "wrappers")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(rows["wrapper"]):
            own = json.loads(text)
            whole = own if whole is None else _merged(whole, own)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [_dump(whole)]})

    while True:
        counts = left.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).head()[0]
        if (most or 0) <= 1:
            return left
        dealt = skew_join(left, counts, ["host"], "inner")
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / PART))
        dealt = dealt.withColumn("part", F.when(F.col("n") <= PART, 0).otherwise(part))
        merged = dealt.groupBy("host", "part").applyInPandas(merge, "host string, wrapper string")
        left = materialize(merged.distinct(), "wrappers")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``text``, the main text, to ``(url, html)`` and whatever else the pages have, without the html."""
    wrappers = infer_wrappers(pages)
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).head()[0] or 0

    def start_hosts():
        return lambda urls: ([host_of(url) for url in urls],)

    def start_packed():
        return lambda urls, found: ([host_of(u) for u in urls], [zlib.compress((x or "").encode(), 3) for x in found])

    def start_text(packed: bool):
        plain = (lambda x: zlib.decompress(x).decode()) if packed else (lambda x: x)
        return lambda found, own: ([main_text(plain(x), w) for x, w in zip(found, own, strict=True)],)

    named = {"host": "__host", "wrapper": "__wrapper"}
    own = wrappers.withColumnsRenamed(named)
    base = pages.drop("text")
    if size <= broadcast_bytes:
        known = add_columns(base, ["url"], "__host string", start_hosts).join(F.broadcast(own), "__host")
        done = add_columns(known, ["html", "__wrapper"], "text string", lambda: start_text(False))
    else:  # the pages travel to their wrappers, compressed
        known = add_columns(base, ["url", "html"], "__host string, __html binary", start_packed).drop("html")
        done = add_columns(skew_join(known, own, ["__host"], "inner"), ["__html", "__wrapper"], "text string", lambda: start_text(True))
    return done.drop("html", "__host", "__wrapper", "__html")
