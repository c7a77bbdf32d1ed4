"""Building the index from pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import (
    KNOWN_CATEGORIES,
    CleaningRules,
    ContentPolicy,
    ScanRules,
)
from pageloom.functions.extract import extract_text
from pageloom.functions.paths import detect_category, path_to_url, scan_filter
from pageloom.functions.policy import is_meaningful_for
from pageloom.functions.strings import clean_text, is_blank
from pageloom.operators.contract import Contract, split_documents, split_vectors
from pageloom.operators.embed import Encoder, HashingEncoder, encode_batch
from pageloom.operators.index import (
    NEW,
    Index,
    backfill_urls,
    prune_disallowed_domains,
    prune_skipped_files,
    replace_documents,
    save_embeddings,
    with_ids,
)
from pageloom.session import materialize, with_computed

NO_TEXT, NOT_MEANINGFUL, EXTRACT_FAILED = "no_text", "not_meaningful", "extract_failed"


def default_extract(path: Column, raw: Column) -> Column:
    return extract_text(path, raw, partial(clean_text, rules=CleaningRules()))


@dataclass(frozen=True)
class BuildSettings:
    """What a build does with each page; every function maps columns to a column."""

    scan: ScanRules
    extract: Callable[[Column, Column], Column] = default_extract
    to_url: Callable[[Column, str], Column] = path_to_url
    categories: tuple = KNOWN_CATEGORIES
    policy: ContentPolicy = ContentPolicy()
    encoder: Encoder = HashingEncoder()
    text_cap: int | None = None  # the setting of the session
    contract: Contract = Contract()


@dataclass(frozen=True)
class BuildResult:
    index: Index
    changed: DataFrame  # documents written by this build, with their status
    changed_vectors: DataFrame
    stats: DataFrame
    rejected: DataFrame  # what broke the contract, with the reason


def extract_pages(pages: DataFrame, settings: BuildSettings) -> DataFrame:
    """``(path, seq, text, skip_reason)`` of the pages that pass the scan rules.

    The reason is null for the pages to be indexed. A page with a ``read_error``,
    as a scan of files gives it, is counted as failed.
    """
    path, text = F.col("path"), F.col("text")
    scanned = pages.where(scan_filter(path, settings.scan))
    extracted = with_computed(scanned, "text", settings.extract(path, F.col("raw")))
    failed = F.col("read_error").isNotNull() if "read_error" in pages.columns else F.lit(False)
    reason = F.when(failed, EXTRACT_FAILED).when(is_blank(text), NO_TEXT).when(
        ~is_meaningful_for(path, text, settings.policy), NOT_MEANINGFUL
    )
    return extracted.select("path", "seq", "text", reason.alias("skip_reason"))


def documents_of(extracted: DataFrame, settings: BuildSettings) -> DataFrame:
    """``(path, url, text, category, seq)`` of the pages to be indexed."""
    path = F.col("path")
    return extracted.where(F.col("skip_reason").isNull()).select(
        "path",
        settings.to_url(path, settings.scan.base).alias("url"),
        "text",
        detect_category(path, settings.categories).alias("category"),
        "seq",
    )


def build_stats(extracted: DataFrame, changed: DataFrame) -> DataFrame:
    """One row of counts.

    A page that comes twice in a build is new once and updated once, as if the
    pages had been saved one after the other.
    """
    seen = extracted.agg(
        F.count_if(F.col("skip_reason").isNull()).alias("saved"),
        F.count_if(F.col("skip_reason") == NO_TEXT).alias("skipped_no_text"),
        F.count_if(F.col("skip_reason") == NOT_MEANINGFUL).alias("skipped_not_meaningful"),
        F.count_if(F.col("skip_reason") == EXTRACT_FAILED).alias("skipped_extract_failed"),
        F.count("*").alias("candidate_files"),
    )
    new = changed.agg(F.count_if(F.col("status") == NEW).alias("new_documents"))
    return seen.withColumn("new_documents", new.scalar()).select(
        "new_documents",
        (F.col("saved") - F.col("new_documents")).alias("updated_documents"),
        (F.col("candidate_files") - F.col("saved")).alias("skipped_documents"),
        "skipped_no_text",
        "skipped_not_meaningful",
        "skipped_extract_failed",
        F.col("saved").alias("total_documents"),
        "candidate_files",
    )


def build_index(
    pages: DataFrame,
    current: Index,
    settings: BuildSettings,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> BuildResult:
    """Index ``pages(path, raw, seq)`` into ``current``; ``read_error`` is optional.

    ``keep`` stores a table that is needed more than once and returns it as
    stored: the extracted texts (for the statistics and the documents), the
    changed documents (for the tables and the encoder) and the new vectors.

    Documents and vectors that break the contract are not saved; what the index has of them stays.
    """
    extracted = keep(extract_pages(pages, settings), "extracted")
    given = keep(with_ids(documents_of(extracted, settings), current.documents), "changed")
    changed, bad_documents = split_documents(given, settings.contract)
    texts = changed.select(F.col("id").alias("doc_id"), "text")
    encoded = keep(encode_batch(texts, settings.encoder, settings.text_cap), "vectors")
    vectors, bad_vectors = split_vectors(encoded, settings.contract)
    index = Index(
        replace_documents(current.documents, changed), save_embeddings(current.vectors, vectors, unique=True)
    )
    return BuildResult(index, changed, vectors, build_stats(extracted, given), bad_documents.union(bad_vectors))


def maintain_and_build(
    pages: DataFrame,
    current: Index,
    settings: BuildSettings,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> tuple[BuildResult, DataFrame]:
    """Clean the index by the scan rules, complete its urls, and build the pages into it.

    The second value is one row: what was deleted for its domain, what for its file name, and the urls filled in.
    """
    allowed, domains = prune_disallowed_domains(current, settings.scan)
    scanned, files = prune_skipped_files(allowed, settings.scan)
    documents, filled = backfill_urls(scanned.documents, settings.scan.base)
    counts = domains.select(
        F.col("deleted_documents").alias("pruned_domains"),
        files.scalar().alias("pruned_files"),
        filled.scalar().alias("filled_urls"),
    )
    kept = Index(keep(documents, "maintained"), keep(scanned.vectors, "maintained-vectors"))
    return build_index(pages, kept, settings, keep), counts
