"""Documents to training sequences: quality, near copies, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; it is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Null texts are kept and packed as empty ones; empty tables give
empty results.

The stages run one after the other on the same executors, which give back little of what earlier ones took. So
all work in Python gets small batches, which is a setting of the session while it runs: these stages store
their rows before they return. Packing remembers fewer chunks of text than operator 5 does alone and cuts fewer at once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import feistel, harmonic, kneser_ney, signature_tree
from pageloom.llm.common import small_batches, table
from pageloom.llm.queries import TOKENIZER
from pageloom.session import materialize

MEMO = 50_000  # chunks that a worker remembers while it packs
SLICE_CHARS = 400_000  # of texts that it cuts into chunks at once


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the quantile of their language."""
    model = kneser_ney.fit(docs, table(spark, sf_dir, "labels"))
    return _in_small_batches(kneser_ney.keep_good(docs, model), "quality")


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    return signature_tree.keep_one(docs)


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; ``n_chars`` follows the text."""
    # Columns of the documents that are called like the counts of pseudonyms keep their values.
    own = {f"n_{kind}": f"_own_n_{kind}" for kind in feistel.KINDS if f"n_{kind}" in docs.columns}
    done = feistel.pseudonymize(docs.withColumnsRenamed(own)).drop(*own)
    done = done.withColumnsRenamed({new: name for name, new in own.items()}).select(*docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")))
    return _in_small_batches(done, "pseudonyms")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    packed = harmonic.pack(docs, public_tokenizers.path(TOKENIZER), memo=MEMO, slice_chars=SLICE_CHARS)
    packed = packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
    return _in_small_batches(packed, "packing")


def _in_small_batches(frame: DataFrame, name: str) -> DataFrame:
    with small_batches(frame.sparkSession):
        return materialize(frame, name)


STAGES = [
    ("quality", good_documents),
    ("near_copies", different_documents),
    ("pseudonyms", private_documents),
    ("packing", packed_sequences),
]
STORED = {good_documents, private_documents, packed_sequences}  # have stored what they return

# Perplexity, keyed permutations and byte-pair ids are beyond SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage not in STORED:
            docs = materialize(docs, name)
    return docs
