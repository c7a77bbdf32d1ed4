"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    bpe_tree,
    chat_grammar,
    feistel,
    fill_middle,
    filter_audit,
    harmonic,
    kneser_ney,
    licenses,
    nn_descent,
    signature_tree,
    syncmers,
    warc_merge,
    wrappers,
)
from pageloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOKENIZER = "word_bpe_49k.json"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _sha256(text: str):
    return F.sha2(F.encode(text, "utf-8"), 256)


@query
def op1_warc_merge(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_merge.capture_history(pages)


@query
def op2_bpe_tree(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_tree.encode(documents, path, decoded=True)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        _sha256("decoded").alias("decoded_sha256"),
    )


@query
def op4_syncmers(spark, sf_dir):
    found = syncmers.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        _sha256("edited").alias("edited_sha256"),
        syncmers.fingerprint(F.col("hashes")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        syncmers.likeness(F.col("hashes"), F.col("next.hashes")).alias("near_next"),
    )


@query
def op5_harmonic(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = harmonic.pack(documents, public_tokenizers.path(TOKENIZER))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op8_feistel(spark, sf_dir):
    return feistel.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_signature_tree(spark, sf_dir):
    return signature_tree.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_kneser_ney(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = kneser_ney.fit(documents, table(spark, sf_dir, "labels"))
    done = kneser_ney.with_quality(documents, model)
    return done.select("doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), "good")


@query
def op3_nn_descent(spark, sf_dir):
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op6_licenses(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    # The documents as files: a directory per source and language, with subdirectories; some are licence files.
    path = F.concat_ws(
        "/",
        "source",
        "lang",
        F.concat(F.lit("d"), (F.col("doc_id") % 100).cast("string")),
        F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat("doc_id", F.lit(".txt"))),
    )
    found = licenses.scan(documents.select(path.alias("path"), "text"))
    number = F.regexp_extract("path", r"(\d+)(\.txt)?$", 1).cast("long")
    return found.select(number.alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), "how", "from_dir")


@query
def op7_wrappers(spark, sf_dir):
    found = wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op11_filter_audit(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    flags = filter_audit.document_flags(documents, table(spark, sf_dir, "labels"))
    return filter_audit.audit(flags)


@query
def op12_chat_grammar(spark, sf_dir):
    # One more conversation whose texts are made of control strings.
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    done = chat_grammar.assemble(chat_grammar.format_turns(turns))
    read = done.select(
        "conv_id",
        chat_grammar.parsed(F.col("formatted")).alias("turns"),
        chat_grammar.learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "utf-8"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        _sha256("learned").alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op13_fill_middle(spark, sf_dir):
    done = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        _sha256("fim_text").alias("output_sha256"),
        F.sha2(F.encode(fill_middle.restored(F.col("fim_text"), F.col("fim_form")), "utf-8"), 256).alias("restored_sha256"),
    )
