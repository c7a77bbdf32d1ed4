"""Pages from a table of crawled web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CATEGORY, _HOSTS = "category_key", "host_bucket"  # directories of stored pages
# Fixed value: parts of an address.
_ADDRESS = r"\A[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)"


def mirror_path(url: Column, base: str, category: Column) -> Column:
    """Where a mirror keeps the page: ``<base><category>/<host><path>``."""
    return F.concat(
        F.lit(base),
        category,
        F.lit("/"),
        F.regexp_extract(url, _ADDRESS, 1),
        F.regexp_extract(url, _ADDRESS, 2),
    )


def first_segment(url: Column) -> Column:
    """First directory of the path of an address."""
    return F.split_part(F.regexp_extract(url, _ADDRESS, 2), F.lit("/"), F.lit(2))


def pages_from_table(table: DataFrame, base: str) -> DataFrame:
    """``(path, raw, seq)`` from ``(page_id, url, html)``; the first segment is the category."""
    url = F.col("url")
    return table.select(
        mirror_path(url, base, first_segment(url)).alias("path"),
        F.col("html").alias("raw"),
        F.col("page_id").alias("seq"),
    )


def write_pages(pages: DataFrame, directory: str, base: str, hosts: int = 16) -> None:
    """Store ``(path, raw, seq)`` by category directory and bucket of the host.

    A host is in one bucket; within it, pages are cut into files by ranges of their paths, so a
    host with a third of all pages is many files.
    """
    below = F.substring(F.col("path"), len(base) + 1, 2**31 - 1)
    category = F.when(F.startswith(F.col("path"), F.lit(base)) & F.contains(below, F.lit("/")), F.split_part(below, F.lit("/"), F.lit(1)))
    host = F.pmod(F.xxhash64(F.split_part(below, F.lit("/"), F.lit(2))), F.lit(hosts)).cast("int")
    keyed = pages.withColumns({_CATEGORY: F.concat(F.lit("c-"), F.coalesce(category, F.lit(""))), _HOSTS: host})
    order = (_CATEGORY, _HOSTS, "path")
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(_CATEGORY, _HOSTS).parquet(directory)


def read_pages(spark: SparkSession, directory: str, category: str | None = None, known: tuple = ()) -> DataFrame:
    """``(path, raw, seq)`` of stored pages; of one category, its directory alone is read."""
    pages = spark.read.schema(f"path string, raw string, seq long, {_CATEGORY} string, {_HOSTS} int").parquet(directory)
    if category:
        pages = pages.where(F.col(_CATEGORY) == f"c-{_known(category, known)}")
    return pages.select("path", "raw", "seq")


def _known(category: str, known: tuple) -> str:
    category = category.lower()
    if category not in known:
        raise ValueError(f"unknown category {category!r}, choose from {', '.join(known)}")
    return category


def select_category(pages: DataFrame, base: str, category: str | None, known: tuple) -> DataFrame:
    """The pages of one category directory, or all if no category is given.

    The category is a directory directly below ``base``, so the filter is a prefix of the path. It
    reaches the scan of a table that has the paths; where they are made from addresses, every
    row is read. ``write_pages`` stores pages so that a category is a directory.
    """
    if not category:
        return pages
    return pages.where(F.startswith(F.col("path"), F.lit(f"{base}{_known(category, known)}/")))


def select_sources(
    directories: tuple, category: str | None, known: tuple
) -> tuple:
    """The source directories that belong to a category; all if none is given."""
    if not category:
        return tuple(directories)
    category = _known(category, known)
    matches = tuple(d for d in directories if category in d.lower().split("/"))
    if not matches:
        raise ValueError(f"no source directory belongs to category {category!r}")
    return matches
