"""Exact nearest-neighbour search by Euclidean distance.

The corpus is ``(doc_id, category, embedding)``, a search is a row of
``(query_id, category, embedding)`` where a null or empty category means all
documents, and the result is the ``k`` nearest documents of each query, equal
distances ordered by ``doc_id``.

Each task keeps the k best of the rows it reads, so what leaves the scan is at
most k rows per query and task. Two ways bring queries and corpus together:

* a batch within a byte budget is sent to every task, and the corpus is scanned
  in place, without a shuffle;
* a larger batch is stored in blocks, which every task reads past the rows it holds
  (``operators/streamed.py``); the corpus is not shuffled either.

A corpus that is stored (``write_index``, ``write_pruned``) serves all kinds of search:
single, category-bound, batch and text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.config import DEFAULT_K, MAX_K
from pageloom.operators.embed import Encoder, encode_batch
from pageloom.operators.streamed import QUERY_BLOCK, SAMPLE_ROWS, streamed_hits
from pageloom.operators.topk import TopK, matrix
from pageloom.session import materialize

HITS_SCHEMA = "query_id long, doc_id long, score double"

# Bytes of query vectors that may be sent to every task.
QUERY_BUDGET = 8 * 1024 * 1024
# Results of a single search up to which their ids are fetched.
_FETCHED_K = 1_000
# Parts in which the hits of one query are merged before the final ranking.
_MERGE_PARTS = 16


def searchable(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Corpus of a search: the documents that have a vector."""
    return vectors.join(
        documents.select(F.col("id").alias("doc_id"), "category"), "doc_id", "inner"
    ).select("doc_id", "category", "embedding")


def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")


def _scan_hits(corpus: DataFrame, ids, categories, vectors: np.ndarray, k: int) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast((ids, categories, vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_categories, query_vectors = shared.value
        best = TopK(query_ids, query_categories, query_vectors, k)
        for batch in batches:
            if batch.num_rows:
                best.add(
                    batch.column("doc_id").to_numpy(zero_copy_only=False),
                    batch.column("category").to_pylist(),
                    matrix(batch.column("embedding"), query_vectors.shape[1]),
                )
        names = ["query_id", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in best.hits()], names=names)

    rows = corpus.where(F.col("embedding").isNotNull()).select("doc_id", "category", "embedding")
    return rows.mapInArrow(scan, HITS_SCHEMA)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of the k best hits of each query.

    Every task of the scan contributes up to k hits to a query, so their number
    grows with the corpus: they are merged in parts first.
    """
    order = (F.col("score"), F.col("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(_MERGE_PARTS))
    merged = (
        hits.withColumn("part", part)
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order)))
        .where(F.col("rank") <= k)
    )
    return (
        merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id", "score")
    )


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    query_budget: int = QUERY_BUDGET,
    query_block: int = QUERY_BLOCK,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the k nearest documents of every query.

    ``query_id`` must be unique, and is checked. Up to ``query_budget`` bytes of query vectors
    are read to decide between the two ways described above. ``corpus`` is read
    several times if there are more: give it as stored.
    """
    return _nearest(corpus, queries, k, query_budget, query_block, sample_rows)[0]


def checked_queries(queries: DataFrame) -> DataFrame:
    """``(query_id, category, embedding)`` of the queries that have a vector."""
    return queries.select("query_id", F.col("category").cast("string"), "embedding").where(
        F.col("embedding").isNotNull()
    )


def require_unique(queries: DataFrame) -> None:
    if not queries.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("query_id is not unique")


def _nearest(
    corpus: DataFrame, queries: DataFrame, k: int, query_budget: int, query_block: int, sample_rows: int, stored: bool = True
) -> tuple[DataFrame, bool]:
    """The hits, and whether the batch of queries was within the budget."""
    _check_k(k)
    queries = checked_queries(queries)
    first = queries.select(F.size("embedding")).head()
    if first is None:
        spark = corpus.sparkSession
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double"), True
    most = max(1, query_budget // (4 * max(1, first[0])))
    some = queries.limit(most + 1).toPandas()
    if len(some) > most:
        require_unique(queries)
        corpus = corpus if stored else materialize(corpus, "corpus")
        return rank_hits(streamed_hits(corpus, queries, k, query_block, sample_rows), k), False
    if some["query_id"].duplicated().any():
        raise ValueError("query_id is not unique")
    ids, categories = some["query_id"].to_numpy(), some["category"].to_numpy()
    hits = _scan_hits(corpus, ids, categories, matrix(list(some["embedding"])), k)
    return rank_hits(hits, k), True


def with_documents(hits: DataFrame, documents: DataFrame, small_hits: bool = False) -> DataFrame:
    """Search results: the hits with the fields of their documents.

    Text is read only here, after the ranking. ``small_hits`` says that the hits
    are few by construction (k of a batch within the budget), so they can be
    sent to the scan of the documents instead of shuffling the texts.
    """
    hits = F.broadcast(hits) if small_hits else hits
    return documents.join(hits, documents["id"] == hits["doc_id"]).select(
        "query_id", "rank", "doc_id", "path", "url", "category", "text", "score"
    )


def in_category(documents: DataFrame, category: str | None) -> DataFrame:
    """The documents of a category; all of them if it is null or empty."""
    return documents.where(F.col("category") == category) if category else documents


def score_vectors(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """``(doc_id, score)``: the distance of every vector to one query vector."""
    target = np.asarray(query, dtype=np.float32).astype(np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = matrix(batch.column("embedding"), len(target)) - target
                scores = pa.array(np.sqrt((gap * gap).sum(axis=1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), scores], names=["doc_id", "score"]
                )

    rows = vectors.where(F.col("embedding").isNotNull())
    return rows.select("doc_id", "embedding").mapInArrow(score, "doc_id long, score double")


def search_by_vector(
    documents: DataFrame,
    vectors: DataFrame,
    query: Sequence[float],
    category: str | None = None,
    k: int = DEFAULT_K,
) -> DataFrame:
    """The k documents nearest to one vector, nearest first.

    A vector is reduced to its distance before the join with the documents, so
    the join moves two numbers per document and no vector and no text.
    """
    known = in_category(documents, category).select(F.col("id").alias("doc_id"))
    scores = score_vectors(vectors, query).join(known, "doc_id")
    return _first_documents(scores, in_category(documents, category), k)


def search_corpus(
    corpus: DataFrame,
    documents: DataFrame,
    query: Sequence[float],
    category: str | None = None,
    k: int = DEFAULT_K,
) -> DataFrame:
    """``search_by_vector`` on a stored corpus: one scan, of one category if one is given."""
    scores = score_vectors(in_category(corpus, category), query)
    return _first_documents(scores, in_category(documents, category), k)


def _first_documents(scores: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The documents with the k lowest of ``(doc_id, score)``, in order."""
    _check_k(k)
    if k <= _FETCHED_K:
        # k pairs of numbers are fetched, so that the ids reach the scan of the
        # documents as a filter and only the parts with one of them are read.
        found = scores.orderBy("score", "doc_id").limit(k).collect()
        documents = documents.where(F.col("id").isin([row["doc_id"] for row in found]))
        ranked = scores.sparkSession.createDataFrame(
            [(0, place, row["doc_id"], row["score"]) for place, row in enumerate(found, 1)],
            "query_id long, rank int, doc_id long, score double",
        )
    else:
        ranked = _ranked_in_parts(scores, k)
    return with_documents(ranked, documents, small_hits=k <= _FETCHED_K).orderBy("rank")


def _ranked_in_parts(scores: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of the k lowest scores, with no task that holds them all.

    The scores are cut into ranges, each range is numbered, and shifted by the sizes of those before it.
    """
    ranges = scores.repartitionByRange("score", "doc_id").withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    # One row per task from here on.
    sizes = ranges.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")).where(F.col("offset") < k)
    place = F.row_number().over(Window.partitionBy("part").orderBy("score", "doc_id"))
    ranked = ranges.join(F.broadcast(offsets), "part").withColumn("rank", (F.col("offset") + place).cast("int"))
    return ranked.where(F.col("rank") <= k).select(F.lit(0).cast("long").alias("query_id"), "rank", "doc_id", "score")


def search_category(
    documents: DataFrame,
    vectors: DataFrame,
    query: Sequence[float],
    category: str,
    k: int = DEFAULT_K,
    corpus: DataFrame | None = None,
) -> DataFrame:
    """The category-bound search: a category is required, and k is at most 10.

    With a stored ``corpus``, one scan of its part; the vectors are not read then.
    """
    if not category:
        raise ValueError("a category is required")
    if corpus is not None:
        return search_corpus(corpus, documents, query, category, min(k, MAX_K))
    return search_by_vector(documents, vectors, query, category, min(k, MAX_K))


def _preset(category: str):
    def search(
        documents: DataFrame,
        vectors: DataFrame,
        query: Sequence[float],
        k: int = DEFAULT_K,
        corpus: DataFrame | None = None,
    ) -> DataFrame:
        return search_category(documents, vectors, query, category, k, corpus)

    search.__name__ = search.__qualname__ = f"search_{category}"
    search.__doc__ = f"Category-bound search of the {category} documents."
    return search


# The same search under the names its users know.
pytool = _preset("python")
tytool = _preset("typescript")
cdktool = _preset("cdk")
vuetool = _preset("vue")
awstool = _preset("aws_design")


def search_corpus_batch(
    corpus: DataFrame,
    documents: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    query_budget: int = QUERY_BUDGET,
    query_block: int = QUERY_BLOCK,
    sample_rows: int = SAMPLE_ROWS,
    stored: bool = True,
) -> DataFrame:
    """Search results of a batch of queries, each with its own optional category.

    ``stored`` says that the corpus is a plain scan. If it is not, and the batch is large, it is stored first.
    """
    hits, few = _nearest(corpus, queries, k, query_budget, query_block, sample_rows, stored)
    # Within the budget, k hits of 24 bytes a query are as much as the query vectors for
    # k = 10 and 64 numbers, and less for longer vectors.
    return with_documents(hits, documents, small_hits=few and k <= MAX_K)


def search_batch(
    documents: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, **limits: int
) -> DataFrame:
    """``search_corpus_batch`` on the join of documents and vectors."""
    return search_corpus_batch(searchable(documents, vectors), documents, queries, k, stored=False, **limits)


def encode_queries(queries: DataFrame, encoder: Encoder, text_cap: int | None = None) -> DataFrame:
    """``(query_id, category, embedding)`` for ``(query_id, query, category)``, stored.

    The encoder runs once: what it gives is counted, fetched or shuffled.
    """
    texts = queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))
    encoded = materialize(encode_batch(texts, encoder, text_cap).withColumnRenamed("doc_id", "query_id"), "queries")
    return queries.select("query_id", "category").join(encoded, "query_id")


def search_corpus_texts(
    corpus: DataFrame,
    documents: DataFrame,
    queries: DataFrame,
    encoder: Encoder,
    k: int = DEFAULT_K,
    text_cap: int | None = None,
) -> DataFrame:
    """Search results for texts on a stored corpus; ``encoder`` is the one its vectors were made with."""
    return search_corpus_batch(corpus, documents, encode_queries(queries, encoder, text_cap), k)


def search_texts(
    documents: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    encoder: Encoder,
    k: int = DEFAULT_K,
    text_cap: int | None = None,
) -> DataFrame:
    """Search results for ``(query_id, query, category)``, texts still to be encoded.

    ``encoder`` is the one the vectors were made with.
    """
    return search_batch(documents, vectors, encode_queries(queries, encoder, text_cap), k)


def result_counts(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, total_results)``, 0 for a query without any result."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("total_results"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("total_results", F.lit(0).cast("long")).alias("total_results")
    )
