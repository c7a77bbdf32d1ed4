"""Maintenance of the index tables.

``documents(id, path, url, text, category)`` and ``vectors(doc_id, embedding)``
are DataFrames; every job takes the current ones and returns new ones. Paths are
unique in ``documents`` and ids are unique in both, so joins on them have no hot
keys; keys that come from outside are made distinct first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.config import ScanRules
from pageloom.functions.paths import allowed_domain, path_to_url, skipped_file

DOCUMENTS_SCHEMA = "id long, path string, url string, text string, category string"
VECTORS_SCHEMA = "doc_id long, embedding array<float>"
DOCUMENT_COLUMNS = ("id", "path", "url", "text", "category")

NEW, UPDATED = "new", "updated"


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    vectors: DataFrame


def as_documents(frame: DataFrame) -> DataFrame:
    """The document columns; tables from before there was a ``url`` get a null one."""
    if "url" not in frame.columns:
        frame = frame.withColumn("url", F.lit(None).cast("string"))
    return frame.select(*DOCUMENT_COLUMNS)


# --------------------------------------------------------------------- lookups


def find_by_path(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents with one of the given ``path`` values."""
    return documents.join(paths.select("path").distinct(), "path", "left_semi").select(
        *DOCUMENT_COLUMNS
    )


def find_by_id(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with one of the given ``id`` values."""
    return documents.join(ids.select("id").distinct(), "id", "left_semi")


def find_by_category(documents: DataFrame, category: str) -> DataFrame:
    """All documents of a category."""
    return documents.where(F.col("category") == category)


# ---------------------------------------------------------------------- upsert


def last_per_path(incoming: DataFrame, order: str = "seq") -> DataFrame:
    """One row per path, the last by ``order``.

    Each map task passes on only its last row of a path, so a path that makes up
    much of the input is no hot spot.
    """
    latest = Window.partitionBy("path").orderBy(F.col(order).desc())
    return (
        incoming.withColumn("_place", F.row_number().over(latest))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def assign_ids(new_paths: DataFrame, current_ids: DataFrame) -> DataFrame:
    """``(path, id)``: consecutive ids after the highest one in use.

    The order is by the beginning of the path's MD5 and then by path. It is a
    function of the data alone, so a task that runs again gives the same ids;
    and as the parts are equally large, they can be numbered in parallel and
    shifted by the sizes of the parts before them.
    """
    part = F.conv(F.substring(F.md5(F.encode("path", "UTF-8")), 1, 3), 16, 10).cast("int")
    parted = new_paths.select("path", part.alias("part"))
    sizes = parted.groupBy("part").agg(F.count("*").alias("size"))
    # At most 4096 rows from here on, so one task and a broadcast are fine.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    highest = current_ids.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest"))
    numbered = parted.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("path")))
    return numbered.join(F.broadcast(offsets), "part").select(
        "path", (highest.scalar() + F.col("offset") + F.col("place")).alias("id")
    )


def resolve_ids(paths: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, id, status)``: known paths keep their id, others get a new one.

    ``paths`` must be distinct. Only paths and ids are read, never the texts.
    """
    known = current.select("path", "id")
    paths = paths.select("path")
    # Reduced to the incoming paths first: a small batch then goes to the scan of
    # a large index, not the index through a shuffle.
    updated = known.join(paths, "path", "left_semi")
    fresh = assign_ids(paths.join(updated, "path", "left_anti"), known)
    return updated.withColumn("status", F.lit(UPDATED)).unionByName(
        fresh.withColumn("status", F.lit(NEW))
    )


def with_ids(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """The last row of every incoming path with its ``id`` and ``status``."""
    ids = resolve_ids(incoming.select("path").distinct(), current)
    return last_per_path(incoming).join(ids, "path")


def without_paths(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """The documents that have none of the given ``path`` values."""
    return documents.join(paths.select("path"), "path", "left_anti").select(*DOCUMENT_COLUMNS)


def replace_documents(current: DataFrame, changed: DataFrame) -> DataFrame:
    """``current`` with the rows of ``changed`` in place of those with the same path."""
    return without_paths(current, changed).unionByName(changed.select(*DOCUMENT_COLUMNS))


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The documents after saving ``(path, url, text, category, seq)``.

    A known path keeps its id and gets the new fields; of a path that comes more
    than once the row with the highest ``seq`` counts.
    """
    kept = without_paths(current, incoming.select("path").distinct())
    return kept.unionByName(with_ids(incoming, current).select(*DOCUMENT_COLUMNS))


def save_embeddings(
    vectors: DataFrame, incoming: DataFrame, order: str | None = None, unique: bool = False
) -> DataFrame:
    """The vectors after replacing those with an incoming ``doc_id``.

    Of an id that comes more than once the row with the highest ``order`` counts,
    and of those, or without an order, the one with the greatest embedding.
    ``unique`` says that no id does, and saves a shuffle of the incoming vectors.
    """
    if not unique:
        sorting = [F.col(name).desc() for name in (order, "embedding") if name]
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*sorting))
        incoming = incoming.withColumn("_place", place).where(F.col("_place") == 1)
    kept = vectors.join(incoming.select("doc_id"), "doc_id", "left_anti")
    return kept.select("doc_id", "embedding").unionByName(incoming.select("doc_id", "embedding"))


# ------------------------------------------------------------ deletion, pruning


def _only_vectors_of(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    ids = documents.select(F.col("id").alias("doc_id"))
    return vectors.join(ids, "doc_id", "left_semi")


def _without_vectors_of(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    ids = documents.select(F.col("id").alias("doc_id"))
    return vectors.join(ids, "doc_id", "left_anti")


def delete_by_id(index: Index, ids: DataFrame) -> tuple[Index, DataFrame]:
    """The index without the documents and vectors of the ids, and ``deleted_documents``.

    A vector goes with its id even where there is no document of that id.
    """
    ids = ids.select("id").distinct()
    gone = index.documents.join(ids, "id", "left_semi")
    kept = Index(
        index.documents.join(ids, "id", "left_anti"), _without_vectors_of(index.vectors, ids)
    )
    return kept, _count(gone, "deleted_documents")


def delete_where(index: Index, gone: Column) -> tuple[Index, DataFrame]:
    """The index without the documents that meet a condition, and ``deleted_documents``."""
    gone = F.coalesce(gone, F.lit(False))
    deleted = index.documents.where(gone)
    kept = Index(index.documents.where(~gone), _without_vectors_of(index.vectors, deleted))
    return kept, _count(deleted, "deleted_documents")


def delete_by_domain(index: Index, domain: str) -> tuple[Index, DataFrame]:
    """Delete the documents whose path contains ``domain`` anywhere."""
    return delete_where(index, F.contains(F.col("path"), F.lit(domain)))


def prune_disallowed_domains(index: Index, rules: ScanRules) -> tuple[Index, DataFrame]:
    """Delete the documents of blocked domains."""
    return delete_where(index, ~allowed_domain(F.col("path"), rules.base, rules.blocked_domains))


def prune_skipped_files(index: Index, rules: ScanRules) -> tuple[Index, DataFrame]:
    """Delete the documents of files that the scan would skip."""
    path = F.col("path")
    return delete_where(index, skipped_file(path, rules.skip_name_parts, rules.skip_path_parts))


def prune_dangling_vectors(index: Index) -> Index:
    """Drop the vectors without a document; no search can return them."""
    return Index(index.documents, _only_vectors_of(index.vectors, index.documents))


def backfill_urls(documents: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """The documents with a url derived from the path where there was none, and ``filled_documents``."""
    missing = F.coalesce(F.col("url"), F.lit("")) == ""
    url = F.when(missing, path_to_url(F.col("path"), base)).otherwise(F.col("url"))
    filled = documents.withColumn("url", url).select(*DOCUMENT_COLUMNS)
    return filled, _count(documents.where(missing), "filled_documents")


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))
