"""The registered queries: every operator, run over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.config import DEFAULT_TEXT_CAP
from pageloom.functions import extract, paths, policy, strings
from pageloom.functions.render import render_with_path, render_with_url, structured_results
from pageloom.functions.vectors import l2_distance, split_by_dim, vector_literal
from pageloom.operators import index as ix
from pageloom.operators import search
from pageloom.operators.contract import Contract
from pageloom.operators.embed import HashingEncoder, encode_batch
from pageloom.operators.pruned import read_pruned, search_pruned, search_pruned_batch, write_pruned
from pageloom.plans import tables as t
from pageloom.plans.build import BuildSettings, build_index, maintain_and_build
from pageloom.session import new_dir, with_computed
from pageloom.sources.files import scan_files
from pageloom.sources.pages import pages_from_table, read_pages, select_category, write_pages
from pageloom.sources.snapshots import read_corpus, read_index, read_rejected, write_index
from pageloom.streaming.incremental import compact, current_index, index_stream
from pageloom.streaming.incremental import delete_where as delete_stream_where

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIM = 64  # length of the given vectors


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ----------------------------------------------------------------------- paths


def _paths(name: str, value: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return t.index_paths(spark, sf_dir).select("path", value(F.col("path")).alias(name))

    QUERIES[name] = run


_paths("path_to_url", lambda path: paths.path_to_url(path, t.BASE))
_paths("url_regex_variant", paths.url_from_docs_path)
_paths("detect_category", lambda path: paths.detect_category(path, t.LANGS))
_paths("extract_domain", lambda path: paths.extract_domain(path, t.BASE))
_paths("allowed_domain", lambda path: paths.allowed_domain(path, t.BASE, t.BLOCKED))
_paths("skip_file", paths.skipped_file)


@query
def effective_url(spark, sf_dir):
    url = paths.effective_url(F.col("url"), F.col("path"))
    return t.index_documents(spark, sf_dir).select("id", url.alias("effective_url"))


@query
def scan_filter(spark, sf_dir):
    found = t.index_paths(spark, sf_dir)
    return found.where(paths.scan_filter(F.col("path"), t.RULES))


@query
def candidate_count(spark, sf_dir):
    return scan_filter(spark, sf_dir).agg(F.count("*").alias("candidate_files"))


@query
def source_by_category(spark, sf_dir):
    """The pages stored by category, and one category read back."""
    directory = new_dir(spark, "pages")
    write_pages(t.web_pages(spark, sf_dir), directory, t.BASE)
    return read_pages(spark, directory, "FR", t.LANGS).select("seq", "path")


@query
def source_by_prefix(spark, sf_dir):
    pages = select_category(t.web_pages(spark, sf_dir), t.BASE, "FR", t.LANGS)
    return pages.select("seq", "path")


@query
def category_documents(spark, sf_dir):
    return ix.find_by_category(t.index_documents(spark, sf_dir), "fr").select("id", "path", "text")


# ------------------------------------------------------------------ extraction


@query
def decode_text(spark, sf_dir):
    texts = t.noisy_texts(spark, sf_dir)
    content = F.concat(
        F.encode("text", "UTF-8"), F.unhex(F.lit("FFC3")), F.encode(F.lit("\r\nend\rend"), "UTF-8")
    )
    return texts.select("doc_id", extract.decode_text(content).alias("text"))


@query
def doc_kind(spark, sf_dir):
    pages = t.web_pages(spark, sf_dir)
    bare = pages.select("seq", F.concat(F.lit("page"), "seq").alias("path"), "raw")
    plain = pages.select(
        "seq", F.concat(F.lit("plain"), "seq").alias("path"), F.regexp_replace("raw", "(?i)<(html|!doctype)", "<x").alias("raw")
    )
    marked = pages.select("seq", F.concat("path", F.lit(".MD")).alias("path"), "raw")
    everything = pages.select("seq", "path", "raw").union(bare).union(plain).union(marked)
    path, raw = F.col("path"), F.col("raw")
    return everything.select(
        "seq",
        "path",
        extract.sniff_html(raw).alias("looks_like_html"),
        extract.doc_kind(path, raw).alias("kind"),
        extract.doc_kind(path, raw, sniff_by_name=True).alias("kind_by_name"),
    )


@query
def html_main_text(spark, sf_dir):
    pages = t.web_pages(spark, sf_dir)
    return pages.select("seq", extract.html_main_text(F.col("raw")).alias("text"))


@query
def html_nested_text(spark, sf_dir):
    pages = t.web_pages(spark, sf_dir)
    return pages.select("seq", extract.html_main_text(F.expr(t.NESTED_SQL)).alias("text"))


@query
def markdown_text(spark, sf_dir):
    documents = t.read_documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return documents.select(
        "doc_id", extract.markdown_text(F.expr(t.MARKDOWN_SQL)).alias("text")
    )


# -------------------------------------------------------------------- cleaning


def _cleaning(name: str, step: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return t.noisy_texts(spark, sf_dir).select("doc_id", step(F.col("text")).alias("text"))

    QUERIES[name] = run


_cleaning("clean_css", strings.remove_css)
_cleaning("clean_noise", strings.remove_noise)
_cleaning("clean_lines", strings.drop_noise_lines)
_cleaning("clean_people_sections", strings.remove_people_sections)
_cleaning("dedupe_lines", strings.drop_repeated_lines)
_cleaning("rejoin_words", strings.rejoin_words)
_cleaning("collapse_blanks", strings.collapse_blanks)
_cleaning("break_sentences", strings.break_sentences)
_cleaning("compress_blank_lines", strings.compress_blank_lines)
_cleaning("strip_line_ends", strings.strip_line_ends)
_cleaning("clean_whitespace", strings.tidy_whitespace)
_cleaning("clean_text", strings.clean_text)


# ---------------------------------------------------------------------- policy


@query
def doc_stats(spark, sf_dir):
    documents = t.read_documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    text, category = F.col("text"), F.col("lang")
    return documents.select(
        F.col("doc_id").alias("id"),
        policy.is_valid(F.expr(t.PATH_SQL), text, category).alias("is_valid"),
        policy.has_content(text).alias("has_content"),
        F.expr(t.URL_SQL).isNotNull().alias("has_url"),
        policy.text_stats(text).alias("stats"),
    ).select("id", "is_valid", "has_content", "has_url", "stats.*")


@query
def meaningful(spark, sf_dir):
    texts = t.noisy_texts(spark, sf_dir)
    return texts.select("doc_id", policy.is_meaningful(F.col("text")).alias("meaningful"))


@query
def meaningful_for(spark, sf_dir):
    documents = t.read_documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    path = F.expr(
        "CASE WHEN lang = 'en' THEN '../docs/en/docs.aws.amazon.com/CDK/' ELSE '../docs/' END || source"
    )
    kept = policy.is_meaningful_for(path, F.col("text"))
    return documents.select("doc_id", kept.alias("meaningful"))


@query
def meaningful_policy(spark, sf_dir):
    """Another policy: its own domain, part of the path and limits."""
    kept = policy.is_meaningful_for(F.expr(t.PATH_SQL), F.col("text"), t.POLICY)
    return t.read_documents(spark, sf_dir, "doc_id", "text", "lang", "source").select("doc_id", kept.alias("meaningful"))


@query
def clean_and_keep(spark, sf_dir):
    cleaned = with_computed(t.noisy_texts(spark, sf_dir), "text", strings.clean_text(F.col("text")))
    return cleaned.where(policy.is_meaningful(F.col("text")))


@query
def empty_text(spark, sf_dir):
    documents = t.read_documents(spark, sf_dir, "doc_id", "text", "lang")
    text = F.expr("CASE lang WHEN 'fr' THEN chr(10) || ' ' || chr(9) WHEN 'de' THEN '' ELSE text END")
    return documents.select("doc_id", text.alias("text")).where(~strings.is_blank(F.col("text")))


@query
def embed_text_cap(spark, sf_dir):
    texts = t.noisy_texts(spark, sf_dir)
    capped = F.substring("text", 1, DEFAULT_TEXT_CAP)
    return texts.select("doc_id", F.length(capped).alias("chars"), F.md5(capped).alias("digest"))


# ---------------------------------------------------------------------- search


def _query_vector(spark: SparkSession, sf_dir: str) -> list:
    """The vector of the single searches: the one with id 0."""
    return t.index_vectors(spark, sf_dir).where("doc_id = 0").head()["embedding"]


def _rounded(results: DataFrame) -> DataFrame:
    return results.withColumn("score", F.round("score", 6))


@query
def index_join(spark, sf_dir):
    index = t.index_tables(spark, sf_dir)
    joined = search.searchable(index.documents, index.vectors)
    return joined.select("doc_id", "category", F.size("embedding").alias("dim"))


@query
def l2_distances(spark, sf_dir):
    target = vector_literal(_query_vector(spark, sf_dir))
    score = F.round(l2_distance(F.col("embedding"), target), 6)
    return t.index_vectors(spark, sf_dir).select("doc_id", score.alias("score"))


@query
def vector_search(spark, sf_dir):
    index = t.index_tables(spark, sf_dir)
    vector = _query_vector(spark, sf_dir)
    return _rounded(search.search_by_vector(index.documents, index.vectors, vector))


@query
def vector_search_category(spark, sf_dir):
    index = t.index_tables(spark, sf_dir)
    vector = _query_vector(spark, sf_dir)
    return _rounded(search.search_by_vector(index.documents, index.vectors, vector, "en", 7))


@query
def capped_topk(spark, sf_dir):
    index = t.index_tables(spark, sf_dir)
    vector = _query_vector(spark, sf_dir)
    found = search.search_category(index.documents, index.vectors, vector, "de", 50)
    return _rounded(found)


@query
def snapshot_search(spark, sf_dir):
    """The category-bound search on an index written to storage and read back."""
    directory = new_dir(spark, "index")
    write_index(t.index_tables(spark, sf_dir), directory)
    documents, corpus = read_index(spark, directory).documents, read_corpus(spark, directory)
    vector = _query_vector(spark, sf_dir)
    return _rounded(search.search_corpus(corpus, documents, vector, "en", 7))


@query
def empty_category_snapshot(spark, sf_dir):
    """Documents with an empty category and with none, through a snapshot; what the contract keeps out comes as such."""
    index, directory = t.index_tables(spark, sf_dir), new_dir(spark, "index")
    category = F.expr("CASE category WHEN 'es' THEN '' WHEN 'de' THEN NULL ELSE category END")
    write_index(replace(index, documents=index.documents.withColumn("category", category)), directory, Contract(DIM, ("", "en")))
    none = F.lit(None).cast("string")
    kept = read_index(spark, directory).documents.select(F.lit("documents").alias("part"), "id", "category", none.alias("reason"))
    corpus = read_corpus(spark, directory).where("category = ''").select(F.lit("corpus").alias("part"), F.col("doc_id").alias("id"), "category", none.alias("reason"))
    rejected = read_rejected(spark, directory).select("rejected_from", "id", none.alias("category"), "reason")
    return kept.union(corpus).union(rejected)


def _batch(spark: SparkSession, sf_dir: str, k: int = 5, **limits) -> tuple[DataFrame, DataFrame]:
    index = t.index_tables(spark, sf_dir)
    requests = t.search_requests(spark, sf_dir)
    return search.search_batch(index.documents, index.vectors, requests, k, **limits), requests


@query
def batch_topk(spark, sf_dir):
    return _rounded(_batch(spark, sf_dir)[0]).drop("text")


@query
def batch_topk_blocks(spark, sf_dir):
    # The way taken by batches beyond the budget, here with a budget of one vector, on a stored corpus.
    directory = new_dir(spark, "index")
    write_index(t.index_tables(spark, sf_dir), directory)
    documents, corpus = read_index(spark, directory).documents, read_corpus(spark, directory)
    limits = {"query_budget": 1, "query_block": 500, "sample_rows": 50}
    found = search.search_corpus_batch(corpus, documents, t.search_requests(spark, sf_dir), 10, **limits)
    return _rounded(found).drop("text")


def _pruned(spark: SparkSession, sf_dir: str):
    """A corpus stored by nearest pivot, with parts small enough for the given tables, and its documents."""
    index, directory = t.index_tables(spark, sf_dir), new_dir(spark, "pruned")
    write_pruned(search.searchable(index.documents, index.vectors), directory, part_rows=25, sample_rows=50)
    return read_pruned(spark, directory), index.documents


@query
def pruned_search(spark, sf_dir):
    store, documents = _pruned(spark, sf_dir)
    return _rounded(search_pruned(store, documents, _query_vector(spark, sf_dir)))


@query
def pruned_search_category(spark, sf_dir):
    store, documents = _pruned(spark, sf_dir)
    return _rounded(search_pruned(store, documents, _query_vector(spark, sf_dir), "en", 7))


@query
def pruned_search_batch(spark, sf_dir):
    store, documents = _pruned(spark, sf_dir)
    found = search_pruned_batch(store, documents, t.search_requests(spark, sf_dir), 10, query_block=500)
    return _rounded(found).drop("text")


@query
def structured_search(spark, sf_dir):
    return _rounded(structured_results(_batch(spark, sf_dir, 3)[0]))


@query
def result_counts(spark, sf_dir):
    return search.result_counts(*_batch(spark, sf_dir, 10))


@query
def render_url_form(spark, sf_dir):
    return render_with_url(*_batch(spark, sf_dir))


@query
def render_path_form(spark, sf_dir):
    return render_with_path(*_batch(spark, sf_dir))


# ----------------------------------------------------------------- maintenance


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to save: all of them changed, and the French ones once more."""
    documents = t.index_documents(spark, sf_dir)
    first = documents.select(
        "path", F.lit("https://first/").alias("url"), F.concat(F.lit("* "), "text").alias("text"), "category",
        F.lit(1).alias("seq"),
    )
    second = documents.where("category = 'fr'").select(
        "path", F.lit("https://second/").alias("url"), F.concat("text", F.lit("!")).alias("text"),
        F.lit("en").alias("category"), F.lit(2).alias("seq"),
    )
    return first.unionByName(second)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are in the index already: those with a vector."""
    ids = t.index_vectors(spark, sf_dir).select(F.col("doc_id").alias("id"))
    return ix.find_by_id(t.index_documents(spark, sf_dir), ids)


@query
def upsert(spark, sf_dir):
    return ix.upsert_documents(_stored(spark, sf_dir), _incoming(spark, sf_dir))


@query
def upsert_status(spark, sf_dir):
    saved = ix.with_ids(_incoming(spark, sf_dir), _stored(spark, sf_dir))
    return saved.groupBy("status").agg(F.count("*").alias("documents"))


@query
def save_embeddings(spark, sf_dir):
    vectors = t.index_vectors(spark, sf_dir)
    negated = t.index_documents(spark, sf_dir).join(
        vectors, F.col("id") == F.col("doc_id")
    ).select("doc_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    saved = ix.save_embeddings(vectors, negated)
    return saved.select("doc_id", F.posexplode("embedding").alias("position", "value")).select(
        "doc_id", "position", F.col("value").cast("double").alias("value")
    )


@query
def dimension_check(spark, sf_dir):
    vectors = t.index_vectors(spark, sf_dir)
    short = vectors.select(
        (F.col("doc_id") + 10**9).alias("doc_id"), F.slice("embedding", 1, DIM - 1).alias("embedding")
    )
    good, rejected = split_by_dim(vectors.unionByName(short), DIM)
    return good.select("doc_id", F.lit(True).alias("accepted")).unionByName(
        rejected.select("doc_id", F.lit(False).alias("accepted"))
    )


def _maintained(name: str, job: Callable[[ix.Index], tuple[ix.Index, DataFrame]]) -> None:
    """Three queries of a deletion: what stays of both tables, and the count."""

    def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, _ = job(t.index_tables(spark, sf_dir))
        return index.documents.select(F.lit("documents").alias("kept_in"), "id").unionByName(
            index.vectors.select(F.lit("vectors").alias("kept_in"), F.col("doc_id").alias("id"))
        )

    def count(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(t.index_tables(spark, sf_dir))[1]

    QUERIES[name] = tables
    QUERIES[f"{name}_count"] = count


def _delete_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read_table(spark, sf_dir, "embeddings").where("label < 5").select(
        F.col("vec_id").alias("id")
    )


@query
def delete_ids(spark, sf_dir):
    ids = _delete_labelled(spark, sf_dir)
    index, _ = ix.delete_by_id(t.index_tables(spark, sf_dir), ids)
    return index.documents.select(F.lit("documents").alias("kept_in"), "id").unionByName(
        index.vectors.select(F.lit("vectors").alias("kept_in"), F.col("doc_id").alias("id"))
    )


@query
def delete_ids_count(spark, sf_dir):
    ids = _delete_labelled(spark, sf_dir)
    return ix.delete_by_id(t.index_tables(spark, sf_dir), ids)[1]


_maintained("delete_domain", lambda index: ix.delete_by_domain(index, "src1"))
_maintained("prune_domains", lambda index: ix.prune_disallowed_domains(index, t.RULES))
_maintained("prune_skip", lambda index: ix.prune_skipped_files(index, t.RULES))


@query
def backfill_urls(spark, sf_dir):
    return ix.backfill_urls(t.index_documents(spark, sf_dir), t.BASE)[0].select("id", "path", "url")


@query
def backfill_urls_count(spark, sf_dir):
    return ix.backfill_urls(t.index_documents(spark, sf_dir), t.BASE)[1]


@query
def lookup_paths(spark, sf_dir):
    wanted = t.index_paths(spark, sf_dir)
    return ix.find_by_path(t.index_documents(spark, sf_dir), wanted).select("id", "path", "category")


@query
def lookup_ids(spark, sf_dir):
    return _stored(spark, sf_dir).select("id", "path", "category")


# ------------------------------------------------------------ encoding, build


@query
def embed_hashed(spark, sf_dir):
    vectors = encode_batch(t.noisy_texts(spark, sf_dir), HashingEncoder(DIM))
    return vectors.select("doc_id", F.posexplode("embedding").alias("position", "value")).select(
        "doc_id", "position", F.col("value").cast("double").alias("value")
    )


@query
def text_search(spark, sf_dir):
    """Every page as a query text: the documents nearest to it, by the default encoder."""
    encoder = HashingEncoder(DIM)
    documents = t.index_documents(spark, sf_dir)
    texts = t.read_documents(spark, sf_dir)
    pages = t.web_pages(spark, sf_dir)
    queries = pages.select(
        F.col("seq").alias("query_id"),
        extract.html_main_text(F.col("raw")).alias("query"),
        F.lit("en").alias("category"),
    )
    found = search.search_texts(documents, encode_batch(texts, encoder), queries, encoder, 3)
    return _rounded(found).drop("text")


def _extract_pages(path, raw):
    # Most of the given pages have no suffix, and all have dots in their path.
    return extract.extract_text(path, raw, strings.clean_text, sniff_by_name=True)


SETTINGS = BuildSettings(
    scan=t.RULES, extract=_extract_pages, categories=t.LANGS, encoder=HashingEncoder(DIM)
)


def _built(spark: SparkSession, sf_dir: str):
    """An index of the documents, with the pages built into it."""
    return build_index(t.web_pages(spark, sf_dir), t.index_tables(spark, sf_dir), SETTINGS)


@query
def build_documents(spark, sf_dir):
    return _built(spark, sf_dir).index.documents


@query
def build_stats(spark, sf_dir):
    return _built(spark, sf_dir).stats


@query
def rebuild_stats(spark, sf_dir):
    first = _built(spark, sf_dir)
    return build_index(t.web_pages(spark, sf_dir), first.index, SETTINGS).stats


@query
def reject_dim_build(spark, sf_dir):
    """A build with an encoder of another dimension: its vectors are rejected, and old ones stay."""
    settings = replace(SETTINGS, encoder=HashingEncoder(DIM // 2), contract=Contract(DIM, (*t.LANGS, "unknown")))
    built = build_index(t.web_pages(spark, sf_dir), t.index_tables(spark, sf_dir), settings)
    return built.index.vectors.select(F.lit("kept").alias("part"), F.col("doc_id").alias("id"), F.size("embedding").alias("dim"), F.lit(None).cast("string").alias("reason")).union(
        built.rejected.select("rejected_from", "id", F.lit(None).cast("int"), "reason")
    )


def _maintained_and_built(spark: SparkSession, sf_dir: str):
    return maintain_and_build(t.web_pages(spark, sf_dir), t.index_tables(spark, sf_dir), SETTINGS)


@query
def maintain_and_build_documents(spark, sf_dir):
    return _maintained_and_built(spark, sf_dir)[0].index.documents


@query
def maintain_and_build_stats(spark, sf_dir):
    built, counts = _maintained_and_built(spark, sf_dir)
    return built.stats.withColumns({name: counts.select(name).scalar() for name in counts.columns})


@query
def build_and_search(spark, sf_dir):
    """The flagship: pages to index, and every indexed page looked up in it."""
    built = _built(spark, sf_dir)
    requests = built.changed_vectors.select(
        F.col("doc_id").alias("query_id"), F.lit(None).cast("string").alias("category"), "embedding"
    )
    return _rounded(search.search_batch(built.index.documents, built.index.vectors, requests))


def _from_files(spark: SparkSession, sf_dir: str):
    """An index of the pages as files of a directory, and the directory."""
    folder = t.mirror_of_pages(spark, sf_dir)
    rules = replace(t.RULES, base=f"{folder}/")
    empty = ix.Index(spark.createDataFrame([], ix.DOCUMENTS_SCHEMA), spark.createDataFrame([], ix.VECTORS_SCHEMA))
    return build_index(scan_files(spark, [folder], rules), empty, replace(SETTINGS, scan=rules)), folder


@query
def scan_directory(spark, sf_dir):
    """What a scan of the directory gives."""
    folder = t.mirror_of_pages(spark, sf_dir)
    found = scan_files(spark, [folder], replace(t.RULES, base=f"{folder}/"))
    path = F.concat(F.lit(t.BASE), F.substring("path", len(folder) + 2, 10**6))
    return found.select(path.alias("path"), F.md5("raw").alias("digest"), F.col("read_error").isNotNull().alias("failed"))


@query
def files_build(spark, sf_dir):
    built, folder = _from_files(spark, sf_dir)
    path = F.concat(F.lit(t.BASE), F.substring("path", len(folder) + 2, 10**6))
    return built.index.documents.select(path.alias("path"), "url", "text", "category")


@query
def files_build_stats(spark, sf_dir):
    return _from_files(spark, sf_dir)[0].stats


def _streamed(spark: SparkSession, sf_dir: str, directory: str, checkpoint: str, folder: str, waves: range) -> None:
    """Follow the pages wave by wave: in the first most pages, then the changed and the others."""
    pages = t.read_table(spark, sf_dir, "pages")
    for wave in waves:
        given = pages.where(t.WAVES_SQL[wave][0]).withColumn("html", F.expr(t.WAVES_SQL[wave][1]))
        given.write.parquet(f"{folder}/wave-{wave}")
        stream = spark.readStream.schema(pages.schema).parquet(f"{folder}/*")
        tasks = spark.sparkContext.defaultParallelism
        index_stream(pages_from_table(stream, t.BASE), directory, checkpoint, SETTINGS, tasks).awaitTermination()


def _places(spark: SparkSession) -> tuple[str, str, str]:
    return new_dir(spark, "stream"), new_dir(spark, "stream-checkpoint"), new_dir(spark, "stream-pages")


@query
def stream_index(spark, sf_dir):
    """The pages as a stream in three waves, into an index of its own."""
    directory, checkpoint, folder = _places(spark)
    _streamed(spark, sf_dir, directory, checkpoint, folder, range(3))
    return current_index(spark, directory).documents


def _deleted(spark: SparkSession, sf_dir: str, waves: int) -> str:
    """A streamed index with a host deleted behind its first wave, followed for further waves."""
    directory, checkpoint, folder = _places(spark)
    _streamed(spark, sf_dir, directory, checkpoint, folder, range(1))
    delete_stream_where(spark, directory, F.contains(F.col("path"), F.lit(t.DELETED_HOST)))
    _streamed(spark, sf_dir, directory, checkpoint, folder, range(1, waves))
    return directory


def _both_tables(index: ix.Index) -> DataFrame:
    return index.documents.select(F.lit("documents").alias("kept_in"), "id", "path").unionByName(
        index.vectors.select(F.lit("vectors").alias("kept_in"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("path"))
    )


@query
def stream_delete(spark, sf_dir):
    return _both_tables(current_index(spark, _deleted(spark, sf_dir, 1)))


@query
def stream_reinsert(spark, sf_dir):
    """Pages of the deleted host that come again are there again, under the ids they had."""
    return _both_tables(current_index(spark, _deleted(spark, sf_dir, 3)))


@query
def stream_compact(spark, sf_dir):
    """The same index compacted, and followed with a new checkpoint by the pages that came last."""
    directory, target = _deleted(spark, sf_dir, 2), new_dir(spark, "stream-compact")
    compact(spark, directory, target)
    _streamed(spark, sf_dir, target, *_places(spark)[1:], range(2, 3))
    return _both_tables(current_index(spark, target))
