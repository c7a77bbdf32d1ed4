"""The index tables on storage.

A job never overwrites what it reads: it writes a new snapshot directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.contract import REJECTED_SCHEMA, Contract, split_documents, split_vectors
from pageloom.operators.index import DOCUMENT_COLUMNS, VECTORS_SCHEMA, Index, as_documents
from pageloom.operators.search import searchable

# The category is a directory. An empty name would be read back as null, so all have a mark.
_KEY, _MARK = "category_key", "c-"


def _key(category: Column) -> Column:
    return F.concat(F.lit(_MARK), category)


def _category(key: Column) -> Column:
    return F.substring(key, len(_MARK) + 1, 2**31 - 1)


def _write(rows: DataFrame, number: str, directory: str, blooms: tuple = ()) -> None:
    """By category, and within it by ranges of the number, so files are equally large and a lookup needs few."""
    keyed = rows.withColumn(_KEY, _key(F.col("category"))).drop("category")
    writer = keyed.repartitionByRange(_KEY, number).sortWithinPartitions(_KEY, number).write.partitionBy(_KEY)
    for key in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(directory)


def write_index(index: Index, directory: str, contract: Contract | None = None) -> None:
    """Write the documents, the vectors and the search corpus of an index.

    The corpus holds the join that every search needs, by category, so that a
    search reads one table and a category-bound search one part of it. Documents
    are looked up by id and by path; Bloom filters on both let a lookup of a few
    keys skip the parts of the table that have none of them.

    With a contract, rows that break it are written to a table of their own, with the reason.
    """
    spark = index.documents.sparkSession
    documents, vectors = index.documents, index.vectors
    if contract is not None:
        documents, bad_documents = split_documents(documents, contract)
        vectors, bad_vectors = split_vectors(vectors, contract)
        bad_documents.union(bad_vectors).write.parquet(f"{directory}/rejected")
    _write(documents.select(*DOCUMENT_COLUMNS), "id", f"{directory}/documents", ("id", "path"))
    vectors.write.parquet(f"{directory}/vectors")
    written = read_index(spark, directory)
    _write(searchable(written.documents, written.vectors), "doc_id", f"{directory}/corpus")


def read_index(spark: SparkSession, directory: str) -> Index:
    """The documents and vectors of a snapshot. A filter on ``category`` chooses directories."""
    documents = spark.read.schema(f"id long, path string, url string, text string, {_KEY} string").parquet(f"{directory}/documents")
    vectors = spark.read.schema(VECTORS_SCHEMA).parquet(f"{directory}/vectors")
    return Index(as_documents(documents.withColumn("category", _category(F.col(_KEY)))), vectors)


def read_rejected(spark: SparkSession, directory: str) -> DataFrame:
    """What a contract kept out of a snapshot, with the reason."""
    return spark.read.schema(REJECTED_SCHEMA).parquet(f"{directory}/rejected")


def read_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """The search corpus of a snapshot, partitioned by category."""
    corpus = spark.read.schema(f"doc_id long, embedding array<float>, {_KEY} string").parquet(f"{directory}/corpus")
    return corpus.select("doc_id", _category(F.col(_KEY)).alias("category"), "embedding")


def read_legacy_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents written before there was a ``url`` column, with a null one."""
    return as_documents(spark.read.parquet(directory))


def save_bucketed(index: Index, documents_table: str, vectors_table: str, buckets: int) -> None:
    """Save both tables bucketed by id in the catalog of the session.

    The join of documents and vectors then needs no shuffle, in any job.
    """
    writer = index.documents.write.bucketBy(buckets, "id").sortBy("id")
    writer.format("parquet").saveAsTable(documents_table)
    writer = index.vectors.write.bucketBy(buckets, "doc_id").sortBy("doc_id")
    writer.format("parquet").saveAsTable(vectors_table)
