"""From raw files to text: decoding, recognising the kind, and extraction."""

from __future__ import annotations

from functools import partial
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.config import SNIFF_CHARS
from pageloom.functions.paths import file_name
from pageloom.functions.strings import bind, is_blank, pystrip

HTML, MARKDOWN, NO_KIND = "html", "markdown", "none"

_RAW_ELEMENTS = ("script", "style")  # what they hold is no markup, so they do not nest
_DROPPED_ELEMENTS = ("nav", "footer", "table")
_BLOCK_TAG = (
    r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|section|article|main|header|aside|pre|blockquote"
    r"|figure|figcaption|address|details|summary|tr|td|th)|br|hr)(?![\w-])[^>]*>"
)
# Noncharacters that stand for the tags of an article.
_OPENED, _CLOSED = "\ufdd0", "\ufdd1"
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_FRONT_MATTER = r"(?s)\A\s*-{3,}[ \t]*\n.*?\n-{3,}[ \t]*(?:\n|\z)"
# Code within lines of Markdown: between equally many back-ticks, those of one not beyond a blank line.
_CODE_SPAN = (
    r"(?<!`)(`{3,})(?!`)[^\n]*?(?<!`)\1(?!`)"
    r"|(?<!`)``(?!`)[^\n]*?(?<!`)``(?!`)"
    r"|(?<!`)`(?!`)(?:[^`\n]++|\n(?![ \t]*\n))++`(?!`)"
)
# What makes up a line: marks of quotes, and in what follows them the mark of a list item, and a fence.
_QUOTE = r"^((?: {0,3}> ?)+)"
_ITEM = r"^( *(?:[-*+]|\d{1,9}[.)]) +)"
_FENCE = r"^ *(`{3,}(?=[^`]*$)|~{3,})"
_MAY_HOLD_BLOCKS = r"(?m)^[ \t>]*(?:(?:[-*+]|\d{1,9}[.)]) +)?(?:```|~~~)|^[ \t>]*(?: {4}|\t)"
_TEXT, _BLOCK_CODE, _QUOTED_CODE, _FENCE_LINE = 0, 1, 2, 3
# While the marks are taken away, those in code are written as noncharacters.
_MARKS = "*_<>&[]()#-+!.`"
_HIDDEN = "".join(chr(0xFDD0 + i) for i in range(len(_MARKS)))
# Markdown marks and what stays of them, in order. Images go like any tag.
_MARKDOWN_STEPS = (
    (r"(?m)^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S.*$", ""),  # link definitions
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"<(https?://[^>\s]+)>", "$1"),
    (r"(?m)^#{1,6}[ \t]*", ""),
    (r"(?m)^[ \t]*(?:[-*+]|\d+\.|>)[ \t]+", ""),
    (r"\*\*|__|`+", ""),
    (r"\*([^*\s][^*\n]*)\*", "$1"),
    (r"(?s)<!--.*?-->", " "),
    (r"</?[A-Za-z][^>]*>", " "),
    # What is left of `& < >` stands for itself and is written as an entity.
    ("&", "&amp;"),
    (r"&amp;(#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)", "&$1"),
    ("<", "&lt;"),
    (">", "&gt;"),
    (r"(?U)[\s\x1c-\x1f]+", " "),
)


def decode_text(content: Column) -> Column:
    """UTF-8 bytes as text: invalid bytes are dropped, every line ends with ``\\n``.

    Valid bytes stay as they are, replacement characters of the source included.
    """
    raw = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def sniff_html(raw: Column) -> Column:
    """True if the beginning of the text looks like HTML."""
    head = F.lower(F.substring(raw, 1, SNIFF_CHARS))
    return F.coalesce(
        F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype")), F.lit(False)
    )


def doc_kind(path: Column, raw: Column, sniff_by_name: bool = False) -> Column:
    """``markdown``, ``html`` or ``none``.

    Only paths without any dot are sniffed; with ``sniff_by_name`` it is enough
    that the file name has none.
    """
    lower = F.lower(path)
    dotless = ~F.contains(file_name(path) if sniff_by_name else path, F.lit("."))
    is_html = F.endswith(lower, F.lit(".html")) | F.endswith(lower, F.lit(".htm"))
    return (
        F.when(F.endswith(lower, F.lit(".md")), MARKDOWN)
        .when(is_html | (dotless & sniff_html(raw)), HTML)
        .otherwise(NO_KIND)
    )


def _opening(tag: str) -> str:
    return rf"<{tag}(?![\w-])[^>]*>"


def _innermost(tag: str) -> str:
    """An element without another one of its kind in it; the content is the first group."""
    # The possessive loop has no way back, so it needs no stack however long the content is.
    return rf"(?is){_opening(tag)}((?:[^<]++|<(?!/?{tag}(?![\w-])))*+)</{tag}\s*>"


def _count(low: Column, tag: str) -> Column:
    """An upper bound of the opening tags of a kind in a page in lower case, without a regular expression."""
    opening = f"<{tag}"
    return ((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(opening), F.lit("")))) / len(opening)).cast("int")


def _repeated(text: Column, times: Column, mark: str, pattern: str, kept: str) -> Column:
    """``regexp_replace`` over and over, ``times`` times at most, and until it changes nothing; a text without ``mark`` is left as it is."""

    def state(t: Column, changed: Column) -> Column:
        return F.struct(t.alias("text"), (changed & F.contains(F.lower(t), F.lit(mark))).alias("more"))

    def once(before: Column) -> Column:
        new = F.regexp_replace(before["text"], pattern, kept)
        # What the pass before left alone stays as it is, however many passes are to come.
        return F.when(before["more"], bind(new, lambda t: state(t, t != before["text"]))).otherwise(before)

    def passes(n: Column) -> Column:
        whole = F.aggregate(F.sequence(F.lit(1), n), state(text, F.lit(True)), lambda s, _: once(s), lambda s: s["text"])
        return F.when(n > 0, whole).otherwise(text)

    return bind(times, passes)


def _without_raw(low: Column, tag: str, html: Column) -> Column:
    """Without the elements of a kind that hold no markup."""
    whole = rf"(?is){_opening(tag)}.*?</{tag}\s*>"
    return F.when(_count(low, tag) > 0, F.regexp_replace(html, whole, "")).otherwise(html)


def _without(low: Column, tag: str, html: Column) -> Column:
    """Without the elements of a kind, whatever their depth: the innermost go first."""
    return _repeated(html, _count(low, tag), f"<{tag}", _innermost(tag), "")


def _articles(html: Column, low: Column) -> Column:
    """What all outermost articles hold, in their order, nested ones in their place; null if there is none."""

    def joined(h: Column, count: Column) -> Column:
        h = _repeated(F.translate(h, _OPENED + _CLOSED, ""), count, "<article", _innermost("article"), f"{_OPENED}$1{_CLOSED}")
        # An article right after the beginning of another one gives up its marks, until none is inside.
        inner = f"{_OPENED}([^{_OPENED}{_CLOSED}]*){_OPENED}([^{_OPENED}{_CLOSED}]*){_CLOSED}"
        whole = bind(h, lambda m: _repeated(m, count - 1, _OPENED, inner, f"{_OPENED}$1\n$2\n"))
        found = F.regexp_extract_all(whole, F.lit(f"{_OPENED}([^{_CLOSED}]*){_CLOSED}"), 1)
        return bind(F.array_join(found, "\n"), lambda text: F.when(text != "", text))

    return bind(_count(low, "article"), lambda count: F.when(count > 0, bind(html, lambda h: joined(h, count))))


def html_main_text(html: Column) -> Column:
    """Main content of a page as text, without comments, tables and page furniture.

    All articles of a page, or else its body. Elements may lie in others of their kind. A tag without its other
    half leaves its content.
    """

    def body(source: Column) -> Column:
        # From the first opening tag to the first closing tag after it; a greedy
        # match and a split are much faster than a lazy match of the content.
        opened = F.regexp_extract(source, rf"(?is){_opening('body')}(.*)\z", 1)
        return bind(
            F.split(opened, r"(?i)</body\s*>", 2),
            lambda parts: F.when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) != ""), F.get(parts, F.lit(0))),
        )

    def main(page: Column, low: Column) -> Column:
        page = F.when(F.contains(page, F.lit("<!--")), F.regexp_replace(page, r"(?s)<!--.*?-->", "")).otherwise(page)
        steps = [partial(_without_raw, low, tag) for tag in _RAW_ELEMENTS] + [partial(_without, low, tag) for tag in _DROPPED_ELEMENTS]
        for step in steps:
            page = bind(page, lambda p: step(p))  # noqa: B023
        return bind(page, lambda p: F.coalesce(_articles(p, low), body(p), p))

    found = bind(html, lambda page: bind(F.lower(page), lambda low: main(page, low)))
    text = F.regexp_replace(found, _BLOCK_TAG, "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    return bind(decode_references(text), lambda t: F.when(is_blank(t), F.lit("")).otherwise(t))


def _replace_matches(text: Column, pattern: str, change) -> Column:
    """The text with ``change(match)`` in place of every match."""

    def joined(t: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), change)
        pairs = F.zip_with(F.split(t, pattern, -1), matches, lambda rest, m: F.concat(rest, F.coalesce(m, F.lit(""))))
        return F.array_join(pairs, "")

    return bind(text, joined)


def decode_references(text: Column) -> Column:
    """Named (HTML 4) and numeric character references as characters; others stay as they are."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def char(reference: Column) -> Column:
        name = F.substring(reference, 2, 12)
        name = F.replace(name, F.lit(";"), F.lit(""))
        digits = F.regexp_replace(name, "^#[xX]?", "")
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(
            F.when(F.startswith(name, F.lit("#")), F.when(valid, number)).otherwise(F.try_element_at(named, name)),
            reference,
        )

    return _replace_matches(text, _REFERENCE, char)


def _hide_code(code: Column) -> Column:
    ticked = F.startswith(code, F.lit("`"))
    plain = F.when(ticked, F.regexp_replace(code, r"\A`+|`+\z", "")).otherwise(code)
    return F.translate(plain, _MARKS, _HIDDEN)


def _found(text: Column, pattern: str, possible: Column) -> Column:
    """What the pattern finds, '' where it is known to find nothing."""
    return F.when(possible, F.regexp_extract(text, pattern, 1)).otherwise("")


def _line_parts(line: Column) -> Column:
    """What the block rules look at: the line behind quote marks, its indent, item mark and fence."""
    line = F.replace(line, F.lit("\t"), F.lit("    "))

    def of(quote: Column, rest: Column) -> Column:
        return bind(
            _found(rest, _ITEM, F.contains(F.lit("-*+0123456789"), F.substring(F.ltrim(rest), 1, 1))),
            lambda item: F.struct(
                (quote != "").alias("quoted"),
                rest.alias("rest"),
                line.alias("line"),
                (F.length(rest) - F.length(F.ltrim(rest))).alias("indent"),
                F.length(item).alias("item"),
                _found(
                    F.substring(rest, F.length(item) + 1, 2**31 - 1), _FENCE, F.contains(rest, F.lit("```")) | F.contains(rest, F.lit("~~~"))
                ).alias("fence"),
                (F.trim(rest) == "").alias("blank"),
                F.trim(line).alias("whole"),
            ),
        )

    found = _found(line, _QUOTE, F.contains(line, F.lit(">")))
    return bind(found, lambda quote: of(quote, F.substring(line, F.length(quote) + 1, 2**31 - 1)))


def _next_state(state: Column, part: Column) -> Column:
    """The state behind a line: the open fence, the indent of the list, the line before, and the kinds of all lines."""
    # Without the marks of its quote, a fence is over.
    inside = (state["fence"] != "") & ~(state["quoted"] & ~part["quoted"])
    # A fence ends at a line of nothing but its sign, as often at least; in a quote, behind the marks of one.
    seen = F.when(state["quoted"], F.trim(part["rest"])).otherwise(part["whole"])
    rest = F.regexp_replace(seen, F.concat(F.lit("["), F.substring(state["fence"], 1, 1), F.lit("]+$")), "")
    closes = inside & (seen != "") & (rest == "") & (F.length(seen) >= F.length(state["fence"]))
    opens = ~inside & (part["fence"] != "")
    far = part["indent"] >= state["list"] + 4
    code = ~inside & ~opens & ~part["blank"] & far & (state["blank"] | state["code"])
    item = ~inside & ~code & (part["item"] > 0)
    ends = ~inside & ~code & ~part["blank"] & (part["indent"] < state["list"]) & state["blank"]
    kind = (
        F.when(closes | opens, F.lit(_FENCE_LINE))
        .when((inside & state["quoted"]) | (code & part["quoted"]), F.lit(_QUOTED_CODE))
        .when(inside | code, F.lit(_BLOCK_CODE))
        .otherwise(F.lit(_TEXT))
    )
    return F.struct(
        F.when(opens, part["fence"]).when(closes | ~inside, "").otherwise(state["fence"]).alias("fence"),
        F.when(opens, part["quoted"]).otherwise(state["quoted"]).alias("quoted"),
        F.when(item, part["item"]).when(ends, F.lit(0)).otherwise(state["list"]).alias("list"),
        F.when(inside, F.lit(False)).otherwise(part["blank"]).alias("blank"),
        (code | (state["code"] & part["blank"] & ~inside)).alias("code"),
        F.concat(state["kinds"], F.array(kind)).alias("kinds"),
    )


def _without_blocks(text: Column) -> Column:
    """The text with the marks in code blocks hidden, and without the signs of fences."""

    def joined(lines: Column) -> Column:
        parts = F.transform(lines, _line_parts)
        start = F.struct(
            F.lit("").alias("fence"), F.lit(False).alias("quoted"), F.lit(0).alias("list"),
            F.lit(True).alias("blank"), F.lit(False).alias("code"), F.array().cast("array<int>").alias("kinds"),
        )
        kinds = F.aggregate(parts, start, _next_state, lambda state: state["kinds"])

        def shown(line: Column, kind: Column) -> Column:
            # What stands behind the sign of a fence stays, as it does in a span.
            code = (
                F.when(kind == _BLOCK_CODE, line)
                .when(kind == _QUOTED_CODE, F.regexp_replace(line, _QUOTE, ""))
                .otherwise(F.regexp_replace(line, "^.*?(?:`{3,}|~{3,})", ""))
            )
            return F.when(kind == _TEXT, line).otherwise(F.translate(code, _MARKS, _HIDDEN))

        return F.array_join(F.zip_with(lines, kinds, shown), "\n")

    return F.when(text.rlike(_MAY_HOLD_BLOCKS), bind(F.split(text, "\n"), joined)).otherwise(text)


def markdown_text(raw: Column) -> Column:
    """Markdown as a single line of text; code stays as it is, with ``& < >`` as entities.

    Code blocks are found line by line, with what is open at a line: fences of either sign, in
    quotes and list items too, and lines indented by four beyond the text or list item they
    stand in. A fence that is not closed goes on to the end.
    """
    raw = bind(F.regexp_replace(raw, _FRONT_MATTER, ""), _without_blocks)
    raw = _replace_matches(raw, _CODE_SPAN, _hide_code)
    for pattern, kept in _MARKDOWN_STEPS:
        raw = F.replace(raw, F.lit(pattern), F.lit(kept)) if pattern in "&<>" else F.regexp_replace(raw, pattern, kept)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        raw = F.replace(raw, F.lit(_HIDDEN[_MARKS.index(mark)]), F.lit(entity))
    return F.coalesce(pystrip(F.translate(raw, _HIDDEN, _MARKS)), F.lit(""))


def extract_text(path: Column, raw: Column, clean, sniff_by_name: bool = False) -> Column:
    """Cleaned text of a file by its kind; '' where there is none.

    ``clean`` is the cleaning, a function from column to column.
    """
    kind = doc_kind(path, raw, sniff_by_name)
    text = F.when(kind == MARKDOWN, markdown_text(raw)).when(kind == HTML, html_main_text(raw))
    return F.coalesce(clean(text), F.lit(""))
