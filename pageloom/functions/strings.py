"""Text columns: stripping, and the ordered cleaning of extracted text.

All functions take and return ``Column`` values and follow the text rules of
Python (Unicode white space, digits and word characters; only ``\\n`` ends a
line), because that is what the documented results are defined by.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.config import CleaningRules

# Fixed value: the characters Python counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same for a Java pattern with Unicode classes, and without the line break.
_SPACE = r"[\s\x1c-\x1f]"
_INLINE_SPACE = r"[\s\x1c-\x1f&&[^\n]]"
_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(value, ddl: str) -> Column:
    """A nested Python value as a constant column of the given type.

    One call into the JVM however large the value; the optimizer folds it.
    """
    return F.from_json(F.lit(json.dumps(value)), ddl)


def java_regex(pattern: str, flags: str = "") -> str:
    """A Python pattern as a Java one with the same meaning on Unicode text."""
    translated = (
        pattern.replace(r"\s", _SPACE)
        .replace(r"\b", _BOUNDARY)
        .replace(r"\Z", r"\z")
    )
    return f"(?dU{flags}){translated}"


def pystrip(text: Column) -> Column:
    """Python's ``str.strip``."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(pystrip(text) == "", F.lit(True))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for blank text."""
    marked = F.regexp_replace(text, r"(?U)[^\s\x1c-\x1f]+", "\x00")
    words = F.length(marked) - F.length(F.replace(marked, F.lit("\x00"), F.lit("")))
    return F.coalesce(words, F.lit(0))


def _fold(text: Column) -> Column:
    """Lower case in which every character that matches an ASCII letter without
    regard to case has become that letter."""
    folded = F.lower(text)
    for char, letter in (("ſ", "s"), ("ı", "i"), ("i̇", "i")):
        folded = F.replace(folded, F.lit(char), F.lit(letter))
    return folded


def literal_hint(pattern: str) -> str:
    """Lower-case string that stands in every match of ``pattern`` ('' if unknown)."""
    repeated = re.fullmatch(r"([^\\\[\](){}.*+?|^$])\{(\d+),?\}", pattern)
    if repeated:
        return (repeated[1] * int(repeated[2])).lower()
    if "|" in pattern:
        return ""
    literal = re.match(r"[A-Za-z ',:-]*", pattern)[0]
    if pattern[len(literal) :][:1] in ("?", "*", "+", "{"):
        literal = literal[:-1]
    return literal.lower()


def _with_hints(rule) -> tuple[str, tuple[str, ...]]:
    return (rule, (literal_hint(rule),)) if isinstance(rule, str) else rule


def remove_patterns(text: Column, rules: Iterable, flags: str = "i") -> Column:
    """Remove each pattern in turn, like a chain of ``regexp_replace``.

    A rule is a pattern or ``(pattern, hints)``. A pattern runs only on text
    that contains one of its hints, and a plain substring search is far cheaper
    than a case-insensitive regex, so clean text passes at little cost. The
    fold over a literal array keeps the plan small and mentions ``text`` once.
    """
    rules = [_with_hints(rule) for rule in rules]
    if not rules:
        return text
    table = constant(
        [{"regex": java_regex(pattern, flags), "hints": hints} for pattern, hints in rules],
        "array<struct<regex string, hints array<string>>>",
    )

    def state(value: Column) -> Column:
        return bind(value, lambda t: F.struct(t.alias("text"), _fold(t).alias("folded")))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.exists(rule["hints"], lambda hint: F.contains(acc["folded"], hint))
        # Removing text can join up a new hint, so a changed text is folded again.
        changed = bind(
            F.regexp_replace(acc["text"], rule["regex"], F.lit("")),
            lambda text: F.when(text == acc["text"], acc).otherwise(state(text)),
        )
        return F.when(hit, changed).otherwise(acc)

    return F.aggregate(table, state(text), step)["text"]


def remove_css(text: Column, rules: CleaningRules = CleaningRules()) -> Column:
    """Step 1: style sheet residue."""
    return remove_patterns(text, rules.css)


def remove_noise(text: Column, rules: CleaningRules = CleaningRules()) -> Column:
    """Step 2: page furniture."""
    return remove_patterns(text, rules.noise)


def drop_noise_lines(text: Column, rules: CleaningRules = CleaningRules()) -> Column:
    """Step 3: lines that consist of page furniture."""
    patterns = rules.line_noise
    if not patterns:
        return text
    if all(re.fullmatch(r"\^[\w\\ '.:?*+]*\$", p) for p in patterns):
        # Whole-line patterns: one match is a line with the break before it, so
        # the text needs no splitting.
        lines = "|".join(p[1:-1].replace(r"\s", _INLINE_SPACE) for p in patterns)
        regex = rf"(?dUi)\n{_INLINE_SPACE}*(?:{lines}){_INLINE_SPACE}*(?=\n|\z)"
        marked = F.concat(F.lit("\n"), text)
        return F.substring(F.regexp_replace(marked, regex, ""), 2, 2**31 - 1)
    regex = "|".join(f"(?:{java_regex(p, 'i')})" for p in patterns)
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.rlike(pystrip(line), F.lit(regex)))
    return F.array_join(kept, "\n")


def remove_people_sections(text: Column, rules: CleaningRules = CleaningRules()) -> Column:
    """Step 4: sections naming contributors and authors."""
    return remove_patterns(text, rules.people_sections, "ims")


def drop_repeated_lines(text: Column) -> Column:
    """Step 5: a line equal to the one before it goes; blank lines stay."""

    def unrepeated(lines: Column) -> Column:
        return bind(
            F.transform(lines, pystrip),
            lambda stripped: F.filter(
                lines,
                lambda _, i: (i == 0)
                | (F.get(stripped, i) == "")
                | (F.get(stripped, i) != F.get(stripped, i - 1)),
            ),
        )

    return F.array_join(bind(F.split(text, "\n"), unrepeated), "\n")


def rejoin_words(text: Column) -> Column:
    """Step 6: a word cut by a line break before its last one to three letters."""
    return F.regexp_replace(text, java_regex(rf"([a-z])\n([a-z]{{1,3}})(?!{_WORD})"), "$1$2")


def collapse_blanks(text: Column) -> Column:
    """Step 7: runs of spaces and tabs become one space."""
    return F.regexp_replace(text, r"\t[ \t]*| [ \t]+", " ")


def break_sentences(text: Column) -> Column:
    """Step 8: a new line after each sentence."""
    return F.regexp_replace(text, java_regex(r"([.!?])\s+([A-Z])"), "$1\n$2")


def compress_blank_lines(text: Column) -> Column:
    """Step 9: at most one blank line in a row."""
    # A run with three line breaks or more, from its first to its last one.
    return F.regexp_replace(text, java_regex(r"\n\s*\n\s*\n"), "\n\n")


def strip_line_ends(text: Column) -> Column:
    """Step 10: no blanks before a line break or the end."""
    return F.regexp_replace(text, r"(?dm)[ \t]+$", "")


def tidy_whitespace(text: Column) -> Column:
    """Steps 6 to 10 and the final strip."""
    for step in (
        rejoin_words,
        collapse_blanks,
        break_sentences,
        compress_blank_lines,
        strip_line_ends,
    ):
        text = step(text)
    return pystrip(text)


def clean_text(text: Column, rules: CleaningRules = CleaningRules()) -> Column:
    """The whole cleaning. The order of the steps is part of the result."""
    text = remove_patterns(text, (*rules.css, *rules.noise))
    text = drop_noise_lines(text, rules)
    text = remove_people_sections(text, rules)
    return tidy_whitespace(drop_repeated_lines(text))
