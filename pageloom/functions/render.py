"""Formatted search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import NO_RESULTS, PREVIEW_CHARS, TRUNCATION_MARK
from pageloom.functions.paths import effective_url


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def truncation_mark(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """The mark for text longer than its preview, else ''."""
    return F.when(F.length(text) > chars, TRUNCATION_MARK).otherwise("")


def result_block(location_label: str, location: Column) -> Column:
    """One formatted result from the columns of a search result row."""
    return F.concat(
        F.lit("=== Result "),
        F.col("rank").cast("string"),
        F.format_string(" (Score: %.4f) ===\n", F.col("score")),
        F.lit("Category: "),
        F.col("category"),
        F.lit(f"\n{location_label}: "),
        location,
        F.lit("\n\n"),
        preview(F.col("text")),
        F.lit("\n"),
        truncation_mark(F.col("text")),
        F.lit("\n" + "=" * 80 + "\n"),
    )


def _render(results: DataFrame, queries: DataFrame, block: Column) -> DataFrame:
    # A group holds the k results of one query, so it is small by construction.
    blocks = results.select("query_id", F.struct("rank", block.alias("block")).alias("entry"))
    texts = blocks.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list("entry"))["block"], "\n").alias("formatted")
    )
    return (
        queries.select("query_id")
        .join(texts, "query_id", "left")
        .select("query_id", F.coalesce("formatted", F.lit(NO_RESULTS)).alias("formatted"))
    )


def render_with_url(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, formatted)`` with the web address of each result."""
    url = effective_url(F.col("url"), F.col("path"))
    return _render(results, queries, result_block("URL", url))


def render_with_path(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, formatted)`` with the path of each result."""
    return _render(results, queries, result_block("Path", F.col("path")))


def structured_results(results: DataFrame) -> DataFrame:
    """``path, category, content, score`` of each result, in rank order per query."""
    return results.select(
        "query_id", "rank", "path", "category", F.col("text").alias("content"), "score"
    )
