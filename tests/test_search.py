import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from pageloom.functions.render import render_with_path, render_with_url, structured_results
from pageloom.functions.vectors import l2_distance, require_dim, split_by_dim, vector_literal
from pageloom.operators import pruned, search, streamed, topk
from pageloom.operators.index import DOCUMENTS_SCHEMA, VECTORS_SCHEMA, Index
from pageloom.sources.snapshots import read_corpus, read_index, save_bucketed, write_index

DIM = 8
QUERIES = "query_id long, category string, embedding array<float>"


@pytest.fixture(scope="module")
def data(spark):
    """Documents and vectors with a third of all vectors equal, and both kinds of orphans."""
    chance = np.random.default_rng(3)
    vectors = {i: chance.normal(size=DIM).astype(np.float32) for i in range(600)}
    for i in range(0, 600, 3):
        vectors[i] = vectors[0]
    categories = {i: ("a" if i % 3 == 0 else "bcd"[i % 3]) for i in range(50, 700)}
    documents = spark.createDataFrame(
        [(i, f"/docs/{c}/h.org/{i}.html", None if i % 2 else "", f"text {i}" * (i % 300), c) for i, c in categories.items()],
        DOCUMENTS_SCHEMA,
    )
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], VECTORS_SCHEMA)
    return documents.repartition(5).cache(), table.repartition(7).cache(), vectors, categories


def expected(data, query, category, k):
    _, _, vectors, categories = data
    scores = [
        (float(np.sqrt(((v.astype(float) - np.asarray(query, dtype=np.float32)) ** 2).sum())), i)
        for i, v in vectors.items()
        if i in categories and (not category or categories[i] == category)
    ]
    return [(rank, i, round(score, 9)) for rank, (score, i) in enumerate(sorted(scores)[:k], 1)]


def found(results):
    return [
        (r["rank"], r["doc_id"], round(r["score"], 9)) for r in sorted(results.collect(), key=lambda r: r["rank"])
    ]


@pytest.mark.parametrize("category", [None, "", "a", "c", "none"])
@pytest.mark.parametrize("k", [1, 5, 250])
def test_single_search(data, category, k):
    documents, vectors, known, _ = data
    for query in (known[0], known[100]):
        got = search.search_by_vector(documents, vectors, query.tolist(), category, k)
        assert found(got) == expected(data, query, category, k)


def test_single_search_with_many_results(data, monkeypatch):
    documents, vectors, known, _ = data
    monkeypatch.setattr(search, "_FETCHED_K", 3)
    got = search.search_by_vector(documents, vectors, known[1].tolist(), None, 20)
    assert found(got) == expected(data, known[1], None, 20)


def test_self_is_first_with_distance_zero(data):
    documents, vectors, known, _ = data
    assert found(search.search_by_vector(documents, vectors, known[100].tolist()))[0] == (1, 100, 0.0)


def test_bounds_of_k(data):
    documents, vectors, known, _ = data
    with pytest.raises(ValueError):
        search.search_by_vector(documents, vectors, known[0].tolist(), k=0)
    with pytest.raises(ValueError):
        search.nearest(search.searchable(documents, vectors), vectors, k=-1)
    with pytest.raises(ValueError):
        search.search_category(documents, vectors, known[0].tolist(), "")
    capped = search.search_category(documents, vectors, known[1].tolist(), "c", 99)
    assert found(capped) == expected(data, known[1], "c", 10)


def test_presets(data):
    documents, vectors, known, _ = data
    names = {"a": "python", "b": "vue", "c": "aws_design", "d": "cdk"}
    renamed = documents.replace(names, subset="category")
    assert found(search.pytool(renamed, vectors, known[2].tolist())) == expected(data, known[2], "a", 5)
    assert found(search.awstool(renamed, vectors, known[2].tolist(), 3)) == expected(data, known[2], "c", 3)
    assert found(search.tytool(renamed, vectors, known[2].tolist())) == []


@pytest.fixture(scope="module")
def requests(spark, data):
    _, _, known, _ = data
    made = [(i, [None, "", "a", "c", "none"][i % 5], known[i].tolist()) for i in range(0, 600, 7)]
    return spark.createDataFrame(made, QUERIES), made


@pytest.mark.parametrize("limits", [{}, {"query_budget": 1, "query_block": 20}, {"query_budget": 1, "query_block": 7, "sample_rows": 5}])
@pytest.mark.parametrize("k", [1, 6])
def test_batch_search(data, requests, limits, k):
    documents, vectors, _, _ = data
    frame, made = requests
    got = search.search_batch(documents, vectors, frame, k, **limits).collect()
    for query_id, category, vector in made:
        hits = sorted((r["rank"], r["doc_id"], round(r["score"], 9)) for r in got if r["query_id"] == query_id)
        assert hits == expected(data, vector, category, k)
    counts = dict(rows(search.result_counts(search.search_batch(documents, vectors, frame, k), frame)))
    assert counts == {q: len(expected(data, v, c, k)) for q, c, v in made}


def test_batch_search_in_small_matrices(data, requests, monkeypatch):
    documents, vectors, _, _ = data
    frame, made = requests
    monkeypatch.setattr(topk, "_MATRIX_CELLS", 50)
    ids = np.array([row[0] for row in made])
    wanted = np.array([row[2] for row in made], dtype=float)
    best = topk.TopK(ids, [row[1] for row in made], wanted, 4)
    corpus = sorted(search.searchable(documents, vectors).collect())
    for start in range(0, len(corpus), 77):
        part = corpus[start : start + 77]
        best.add(
            np.array([r["doc_id"] for r in part]),
            [r["category"] for r in part],
            np.array([r["embedding"] for r in part]),
        )
    got = list(zip(*best.hits()))
    for query_id, category, vector in made:
        hits = sorted((round(s, 9), d) for q, d, s in got if q == query_id)
        assert hits == [(s, d) for _, d, s in expected(data, vector, category, 4)]


def test_rows_within_a_known_bound_are_not_partitioned(monkeypatch):
    seen, partition = [], np.partition
    monkeypatch.setattr(topk.np, "partition", lambda a, *rest, **named: seen.append(a.shape) or partition(a, *rest, **named))
    choose = np.random.default_rng(2)
    wanted, corpus = choose.random((40, 8)), choose.random((3000, 8))
    best = topk.TopK(np.arange(40), [""] * 40, wanted, 3)
    for at in range(0, 3000, 1000):
        best.add(np.arange(at, at + 1000), ["a"] * 1000, corpus[at : at + 1000])
    assert sum(rows for rows, _ in seen) <= 50
    gaps = np.sqrt(((wanted[:, None] - corpus[None]) ** 2).sum(axis=2))
    order = np.argsort(gaps, axis=1)[:, :3]
    assert best.hits()[1].reshape(40, 3).tolist() == order.tolist()


def test_small_parts_are_read_by_few_tasks(spark, tmp_path):
    choose = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], choose.random(4).tolist()) for i in range(400)]
    pruned.write_pruned(spark.createDataFrame(rows, "doc_id long, category string, embedding array<float>"), str(tmp_path / "p"), part_rows=4, sample_rows=50)
    store = pruned.read_pruned(spark, str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        assert pruned._in_few_tasks(store, store.corpus).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_queries(data, requests):
    documents, vectors, _, _ = data
    assert search.search_batch(documents, vectors, requests[0].where("false")).count() == 0


def test_plans_have_no_all_pairs_join(data, requests):
    documents, vectors, known, _ = data
    for limits in ({}, {"query_budget": 1}):
        text = plan(search.search_batch(documents, vectors, requests[0], **limits))
        assert "Cartesian" not in text and "NestedLoop" not in text
    text = plan(search.search_by_vector(documents, vectors, known[0].tolist()))
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """20,000 vectors around 40 centres, a fifth of them equal, stored in 12 files, and 60 queries."""
    chance = np.random.default_rng(8)
    centres = 10 * chance.normal(size=(40, DIM))
    vectors = (centres[chance.integers(40, size=20_000)] + chance.normal(size=(20_000, DIM))).astype(np.float32)
    vectors[::5] = vectors[0]
    folder = str(tmp_path_factory.mktemp("many") / "corpus")
    rows_ = [(i, "ab"[i % 2] if i % 100 else "rare", v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows_, "doc_id long, category string, embedding array<float>")
    frame.repartition(12).write.parquet(folder)
    wanted = [(i, [None, "a", "rare", "none"][i % 4], vectors[i * 3].tolist()) for i in range(60)]
    return spark.read.parquet(folder), spark.createDataFrame(wanted, QUERIES), vectors


def brute_force(many, k):
    _, queries, vectors = many
    kinds = np.array(["ab"[i % 2] if i % 100 else "rare" for i in range(len(vectors))])
    found = set()
    for row in queries.collect():
        scores = np.sqrt(((vectors.astype(float) - np.asarray(row["embedding"], np.float32)) ** 2).sum(axis=1))
        ids = np.arange(len(vectors)) if not row["category"] else np.flatnonzero(kinds == row["category"])
        best = ids[np.lexsort((ids, scores[ids]))][:k]
        found |= {(row["query_id"], rank, int(i), round(float(scores[i]), 9)) for rank, i in enumerate(best, 1)}
    return found


def ranked(frame):
    return {(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in frame.collect()}


@pytest.mark.parametrize("k", [1, 8])
def test_large_batches_on_a_stored_corpus(many, k):
    corpus, queries, _ = many
    got = search.nearest(corpus, queries, k, query_budget=1, query_block=16, sample_rows=50)
    assert ranked(got) == brute_force(many, k)


def test_the_corpus_of_a_large_batch_is_not_shuffled(many):
    corpus, queries, _ = many
    hits = streamed.streamed_hits(corpus, queries, 3, 16, 50)
    text = plan(hits)
    assert "Exchange" not in text and "PythonMapInArrow" in text.replace("MapInArrow", "PythonMapInArrow")


def test_hits_follow_the_queries_and_not_the_tasks(many, monkeypatch):
    corpus, queries, _ = many
    k = 4
    monkeypatch.setattr(streamed, "THIN", 4)
    everywhere = queries.withColumn("category", F.lit(None).cast("string"))
    blocks = streamed.store_queries(everywhere, 16)
    assert len(blocks.files) >= 4
    samples = streamed.thinned(corpus, corpus.count(), 6000)
    assert len(samples) == 1
    bounds = streamed.sampled_bounds(samples, blocks, k)
    for tasks in (3, 80):
        cut = corpus.repartition(tasks)
        # Every task and query gives k rows without bounds, and about THIN * k in all with them.
        assert streamed.stream_blocks(cut, blocks, k).count() == 60 * k * tasks
        assert 60 * k <= streamed.stream_blocks(cut, blocks, k, bounds).count() <= 60 * k * 4 * 2


def test_samples_lie_in_each_other(many):
    corpus, _, _ = many
    samples = streamed.thinned(corpus, corpus.count(), 2)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in [corpus, *samples]]
    assert len(ids) >= 3 and all(b < a for a, b in zip(ids, ids[1:]))


@pytest.fixture(scope="module")
def pruned_store(spark, many, tmp_path_factory):
    corpus, _, _ = many
    folder = str(tmp_path_factory.mktemp("pruned") / "corpus")
    pruned.write_pruned(corpus, folder, part_rows=400, sample_rows=500)
    return pruned.read_pruned(spark, folder)


def documents_of(corpus):
    return corpus.select(F.col("doc_id").alias("id"), F.lit("p").alias("path"), F.lit("u").alias("url"), F.lit("t").alias("text"), "category")


@pytest.mark.parametrize("category", [None, "", "a", "rare", "none"])
@pytest.mark.parametrize("k", [1, 20])
def test_pruned_search(many, pruned_store, category, k):
    corpus, _, vectors = many
    for query in (vectors[0], vectors[7], vectors[7] * 3 + 1):
        got = search.search_corpus(corpus, documents_of(corpus), query.tolist(), category, k)
        mine = pruned.search_pruned(pruned_store, documents_of(corpus), query.tolist(), category, k)
        assert rows(mine) == rows(got)


def test_pruned_search_reads_few_parts(many, pruned_store):
    parts = pruned_store.parts.select("part").distinct().count()
    assert parts >= 40
    query = many[2][7].tolist()
    reading = pruned.read_parts(pruned_store, query, None, 10)
    assert np.isfinite(reading.limit) and len(reading.first) == 1
    assert len(reading.rest) < parts / 3
    read = pruned._of_parts(pruned_store, None, reading.first + reading.rest)
    assert 0 < read.select(F.input_file_name()).distinct().count() < len(pruned_store.corpus.inputFiles()) / 2
    scan = plan(pruned._of_parts(pruned_store, "a", reading.first))
    assert "PartitionFilters: [isnotnull(category_key" in scan and "part" in scan.split("PartitionFilters")[1][:200]


def test_equal_vectors_fill_many_parts(pruned_store):
    shells = pruned_store.parts.collect()
    assert max(r["rows"] for r in shells) <= 1200
    thin = [r for r in shells if r["high"] - r["low"] < 1e-12 and r["rows"] > 50]
    assert len(thin) >= 5  # 4,000 equal vectors at one distance from their pivot


@pytest.mark.parametrize("k", [1, 8])
def test_pruned_batch(many, pruned_store, k):
    assert ranked(pruned.nearest_pruned(pruned_store, many[1], k, query_block=16)) == brute_force(many, k)


def test_pruned_batch_leaves_parts_out(many, pruned_store):
    _, queries, _ = many
    few = queries.where("query_id in (1, 5)")
    blocks = streamed.store_queries(few, 16)
    bounds = streamed.sampled_bounds(pruned_store.samples, blocks, 1)
    needed = pruned.needed_parts(pruned_store, blocks, bounds).count()
    assert 0 < needed < pruned_store.parts.select("part").distinct().count()


def test_pruned_corpora_of_odd_rows(spark, tmp_path):
    nan = float("nan")
    given = [(1, "", [0.0, 1.0]), (2, None, [1.0, 1.0]), (3, "c", [nan, 0.0]), (4, "c", None), (5, "c", [5.0, 5.0]), (6, "", [0.0, 1.0])]
    corpus = spark.createDataFrame(given, "doc_id long, category string, embedding array<float>")
    pruned.write_pruned(corpus, str(tmp_path / "odd"), part_rows=1, sample_rows=2)
    store = pruned.read_pruned(spark, str(tmp_path / "odd"))
    assert store.corpus.where("category is null").count() == 1 and store.corpus.where("category = ''").count() == 2
    got = pruned.search_pruned(store, documents_of(corpus), [0.0, 1.0], None, 4)
    assert [(r["doc_id"], round(r["score"], 6)) for r in got.collect()] == [(1, 0.0), (6, 0.0), (2, 1.0), (5, 6.403124)]
    pruned.write_pruned(corpus.where("false"), str(tmp_path / "none"))
    empty = pruned.read_pruned(spark, str(tmp_path / "none"))
    assert pruned.search_pruned(empty, documents_of(corpus), [0.0, 1.0]).count() == 0
    queries = spark.createDataFrame([(1, None, [0.0, 1.0])], QUERIES)
    assert pruned.search_pruned_batch(empty, documents_of(corpus), queries).count() == 0
    with pytest.raises(ValueError, match="numbers and not"):
        pruned.search_pruned(store, documents_of(corpus), [0.0] * 3)


def test_one_stored_corpus_serves_all_searches(spark, data, requests, tmp_path):
    documents, vectors, known, _ = data
    names = {"a": "python", "b": "vue", "c": "aws_design", "d": "cdk"}
    renamed = documents.replace(names, subset="category")
    write_index(Index(renamed, vectors), str(tmp_path / "index"))
    corpus = read_corpus(spark, str(tmp_path / "index"))
    for preset, category in ((search.pytool, "a"), (search.awstool, "c"), (search.cdktool, "d")):
        got = preset(renamed, None, known[2].tolist(), 30, corpus=corpus)
        assert found(got) == expected(data, known[2], category, 10)
    frame, made = requests
    plain = frame.replace(names, subset="category")
    got = search.search_corpus_batch(corpus, renamed, plain, 3)
    assert "Join" not in plan(search.nearest(corpus, plain, 3))
    assert rows(got) == rows(search.search_batch(renamed, vectors, plain, 3))


def test_stored_corpus(spark, data, tmp_path):
    documents, vectors, known, _ = data
    write_index(Index(documents, vectors), str(tmp_path / "index"))
    stored, corpus = read_index(spark, str(tmp_path / "index")), read_corpus(spark, str(tmp_path / "index"))
    assert rows(stored.documents) == rows(documents)
    assert stored.vectors.count() == vectors.count()
    got = search.search_corpus(corpus, stored.documents, known[5].tolist(), "c", 6)
    assert found(got) == expected(data, known[5], "c", 6)
    scan = plan(search.score_vectors(search.in_category(corpus, "c"), known[5].tolist()))
    assert "= c)]" in scan.split("PartitionFilters:")[1].split("\n")[0]
    assert "ReadSchema: struct<doc_id:bigint,embedding:array<float>>" in scan
    assert "Exchange" not in scan
    assert "PushedFilters: [In(id" in plan(got) or "PushedFilters: [IsNotNull(id), In(id" in plan(got)


def test_bucketed_tables_join_without_a_shuffle(spark, data):
    documents, vectors, _, _ = data
    save_bucketed(Index(documents, vectors), "bucketed_documents", "bucketed_vectors", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = search.searchable(spark.table("bucketed_documents"), spark.table("bucketed_vectors"))
        assert "Exchange" not in plan(joined)
        assert joined.count() == search.searchable(documents, vectors).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("drop table bucketed_documents")
        spark.sql("drop table bucketed_vectors")


def test_distance_column(data):
    _, vectors, known, _ = data
    got = vectors.select("doc_id", l2_distance(F.col("embedding"), vector_literal(known[9])).alias("d")).collect()
    for row in got:
        gap = known[row["doc_id"]].astype(float) - known[9]
        assert row["d"] == pytest.approx(np.sqrt((gap**2).sum()), abs=1e-12)


def test_dimension(spark, data):
    bad = spark.createDataFrame([(1, [1.0]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0])], VECTORS_SCHEMA)
    good, rejected = split_by_dim(bad, 2)
    assert [r["doc_id"] for r in good.collect()] == [4]
    assert sorted(r["doc_id"] for r in rejected.collect()) == [1, 2, 3]
    assert require_dim(good, 2).count() == 1
    with pytest.raises(Exception, match="not a vector of 2 numbers"):
        require_dim(bad, 2).collect()


RESULTS = "query_id long, rank int, doc_id long, path string, url string, category string, text string, score double"


def test_rendering(spark):
    results = spark.createDataFrame(
        [
            (1, 2, 20, "/docs/vue/v.org/b.html", "", "vue", "é" * 1501, 0.98765),
            (1, 1, 10, "/docs/vue/v.org/a.html", "https://stored/", "vue", "x" * 1500, 0.5),
        ],
        RESULTS,
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")

    def block(rank, score, where, text, mark):
        return f"=== Result {rank} (Score: {score}) ===\nCategory: vue\n{where}\n\n{text}\n{mark}\n{'=' * 80}\n"

    first = ("x" * 1500, ""), ("é" * 1500, "...(truncated)")
    urls = block(1, "0.5000", "URL: https://stored/", *first[0]), block(2, "0.9877", "URL: https://v.org/b", *first[1])
    where = ("Path: /docs/vue/v.org/a.html", "Path: /docs/vue/v.org/b.html")
    paths = block(1, "0.5000", where[0], *first[0]), block(2, "0.9877", where[1], *first[1])
    assert rows(render_with_url(results, queries)) == [(1, "\n".join(urls)), (2, "No results found.")]
    assert rows(render_with_path(results, queries)) == [(1, "\n".join(paths)), (2, "No results found.")]
    row = structured_results(results).where("rank = 1").head().asDict()
    assert row == {"query_id": 1, "rank": 1, "path": "/docs/vue/v.org/a.html", "category": "vue", "content": "x" * 1500, "score": 0.5}


def test_wrong_shapes_and_repeated_ids_are_refused(spark, data, requests):
    documents, vectors, known, _ = data
    mixed = spark.createDataFrame([(50, [1.0] * 3), (51, [1.0] * 5), (52, [1.0, None])], VECTORS_SCHEMA).coalesce(1)
    query = spark.createDataFrame([(1, None, [1.0] * 4)], QUERIES)
    for limits in ({}, {"query_budget": 1}):
        with pytest.raises(Exception, match="numbers and not|holds a null"):
            search.search_batch(documents, mixed, query, **limits).collect()
        with pytest.raises(ValueError, match="not unique"):
            search.search_batch(documents, vectors, requests[0].union(requests[0]), **limits)
    with pytest.raises(Exception, match="numbers and not|holds a null"):
        search.search_by_vector(documents, mixed, [1.0] * 4)


def test_small_blocks_are_joined(spark, many):
    _, queries, _ = many
    blocks = streamed.store_queries(queries, 16)
    alone = [(number, streamed.load_block(uri, None)) for number, uri in enumerate(blocks.files)]
    sizes = {number: len(block.ids) for number, block in alone if block is not None}
    dim = next(block for _, block in alone if block is not None).vectors.shape[1]
    together = list(streamed.loaded_blocks(blocks, None, dim))
    assert len(sizes) > 2 and len(together) == 1
    numbers, block = together[0]
    assert {number: int((numbers == number).sum()) for number in set(numbers.tolist())} == sizes
    assert block.ids.tolist() == [i for _, b in alone if b is not None for i in b.ids.tolist()]
    assert np.array_equal(block.vectors, np.concatenate([b.vectors for _, b in alone if b is not None]))


def test_many_small_parts_are_written_by_few_tasks(spark, tmp_path, monkeypatch):
    choose = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], choose.random(4).tolist()) for i in range(1200)]
    corpus = spark.createDataFrame(rows, "doc_id long, category string, embedding array<float>")
    seen, cut = [], type(corpus).repartitionByRange
    monkeypatch.setattr(type(corpus), "repartitionByRange", lambda self, n, *key: seen.append(n) or cut(self, n, *key))
    pruned.write_pruned(corpus, str(tmp_path / "p"), part_rows=10, sample_rows=50)
    assert seen == [max(spark.sparkContext.defaultParallelism, 2)]
    store = pruned.read_pruned(spark, str(tmp_path / "p"))
    sizes = [r["n"] for r in store.parts.groupBy("part").agg(F.sum("rows").alias("n")).collect()]
    assert len(sizes) >= 120 and max(sizes) <= 10 and sum(sizes) == 1200


def test_least_distances_are_at_most_the_distances():
    vectors = np.random.default_rng(9).random((300, 8))
    least = streamed._least_distances(vectors, vectors[5], (vectors * vectors).sum(axis=1))
    exact = streamed.distances(vectors, vectors[5])
    assert (least <= exact).all() and np.allclose(least, exact, atol=1e-4)
    assert np.isnan(streamed._least_distances(np.full((1, 8), np.nan), vectors[5], np.array([np.nan]))).all()
