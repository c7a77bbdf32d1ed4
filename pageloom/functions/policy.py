"""Which documents are worth indexing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.config import ContentPolicy, Thresholds
from pageloom.functions.strings import bind, pystrip, word_count


def text_stats(text: Column) -> Column:
    """Struct of ``chars`` (stripped), ``lines`` (not blank), ``line_chars`` (their
    stripped lengths added up) and ``words``; all 0 for null text."""
    text = F.coalesce(text, F.lit(""))
    return bind(
        text,
        lambda t: bind(
            F.filter(F.transform(F.split(t, "\n"), pystrip), lambda line: line != ""),
            lambda lines: F.struct(
                F.length(pystrip(t)).cast("long").alias("chars"),
                F.size(lines).cast("long").alias("lines"),
                F.aggregate(
                    lines, F.lit(0).cast("long"), lambda n, line: n + F.length(line)
                ).alias("line_chars"),
                word_count(t).cast("long").alias("words"),
            ),
        ),
    )


def _reaches(stats: Column, limit: Thresholds) -> Column:
    return (
        (stats["chars"] >= limit.chars)
        & (stats["lines"] >= limit.lines)
        # mean line length, without a division that fails on no lines
        & (stats["line_chars"] >= stats["lines"] * F.lit(limit.mean_line))
        & (stats["words"] >= limit.words)
    )


def is_meaningful(text: Column, limit: Thresholds = ContentPolicy().general) -> Column:
    """True if the text has enough characters, lines, line length and words."""
    return bind(text_stats(text), lambda stats: _reaches(stats, limit))


def is_meaningful_for(path: Column, text: Column, policy: ContentPolicy = ContentPolicy()) -> Column:
    """``is_meaningful`` with the relaxed thresholds for the pages the policy names."""
    relaxed = F.contains(path, F.lit(policy.relaxed_domain)) & F.contains(
        F.lower(path), F.lit(policy.relaxed_path_part)
    )
    return bind(
        text_stats(text),
        lambda stats: F.when(relaxed, _reaches(stats, policy.relaxed)).otherwise(
            _reaches(stats, policy.general)
        ),
    )


def is_valid(path: Column, text: Column, category: Column) -> Column:
    """True if none of the three is null or empty."""
    return F.coalesce((path != "") & (text != "") & (category != ""), F.lit(False))


def has_content(text: Column, min_length: int = 200) -> Column:
    """True if the stripped text has at least ``min_length`` characters."""
    return F.coalesce(F.length(pystrip(text)) >= min_length, F.lit(False))
