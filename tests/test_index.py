import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from pageloom.config import ScanRules
from pageloom.operators import index as ix
from pageloom.operators.contract import Contract, split_documents, split_vectors
from pageloom.sources.pages import read_pages, write_pages
from pageloom.sources.snapshots import read_corpus, read_index, read_legacy_documents, read_rejected, write_index

INCOMING = "path string, url string, text string, category string, seq long"


@pytest.fixture(scope="module")
def current(spark):
    documents = spark.createDataFrame(
        [
            (1, "/d/vue/a.org/1.html", "u1", "t1", "vue"),
            (2, "/d/vue/b.org/2.html", None, "t2", "vue"),
            (7, "/d/cdk/a.org.uk/genindex.html", "", "t7", "cdk"),
        ],
        ix.DOCUMENTS_SCHEMA,
    )
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (9, [9.0])], ix.VECTORS_SCHEMA)
    return ix.Index(documents, vectors)


def incoming(spark, *given):
    return spark.createDataFrame(list(given), INCOMING)


def test_upsert(spark, current):
    saved = ix.upsert_documents(
        current.documents,
        incoming(
            spark,
            ("/d/vue/b.org/2.html", "x", "old", "vue", 1),
            ("/new", "n", "first", "c", 2),
            ("/d/vue/b.org/2.html", "y", "new", "cdk", 3),
            ("/new", "m", "second", "e", 5),
        ),
    )
    assert rows(saved.where("id <> 7")) == [
        (1, "/d/vue/a.org/1.html", "u1", "t1", "vue"),
        (2, "/d/vue/b.org/2.html", "y", "new", "cdk"),
        (8, "/new", "m", "second", "e"),
    ]
    assert saved.count() == 4


def test_upsert_twice_is_upsert_once(spark, current):
    batch = incoming(spark, *[(f"/p{i}", "u", f"t{i}", "c", i) for i in range(50)])
    once = ix.upsert_documents(current.documents, batch)
    assert rows(ix.upsert_documents(once, batch).select("id", "path", "text")) == rows(
        once.select("id", "path", "text")
    )


def test_first_upsert_into_nothing(spark):
    empty = spark.createDataFrame([], ix.DOCUMENTS_SCHEMA)
    saved = ix.upsert_documents(empty, incoming(spark, ("/a", "u", "t", "c", 1), ("/b", "u", "t", "c", 1)))
    assert sorted(r["id"] for r in saved.collect()) == [1, 2]


def test_one_path_in_a_third_of_the_rows(spark, current):
    batch = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "/hot").otherwise(F.concat(F.lit("/p"), "id")).alias("path"),
        F.lit("u").alias("url"),
        F.concat(F.lit("t"), "id").alias("text"),
        F.lit("c").alias("category"),
        F.col("id").alias("seq"),
    )
    saved = ix.with_ids(batch, current.documents)
    assert saved.count() == 6001
    assert [r["text"] for r in saved.where("path = '/hot'").collect()] == ["t8997"]
    ids = sorted(r["id"] for r in saved.collect())
    assert ids == list(range(8, 8 + 6001))
    # Map tasks pass on one row per path.
    text = plan(ix.last_per_path(batch))
    assert text.count("WindowGroupLimit") >= 2
    again = ix.with_ids(batch.repartition(13), current.documents)
    assert rows(again.select("path", "id")) == rows(saved.select("path", "id"))


def test_upsert_has_no_all_pairs_join(spark, current):
    text = plan(ix.upsert_documents(current.documents, incoming(spark, ("/a", "u", "t", "c", 1))))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_lookups(spark, current):
    paths = spark.createDataFrame([("/d/vue/a.org/1.html",)] * 3 + [("/none",)], "path string")
    assert rows(ix.find_by_path(current.documents, paths)) == [(1, "/d/vue/a.org/1.html", "u1", "t1", "vue")]
    ids = spark.createDataFrame([(2,), (2,), (5,)], "id long")
    assert [r["id"] for r in ix.find_by_id(current.documents, ids).collect()] == [2]
    assert sorted(r["id"] for r in ix.find_by_category(current.documents, "vue").collect()) == [1, 2]


def kept(result):
    index, count = result
    documents = sorted(r["id"] for r in index.documents.collect())
    vectors = sorted(r["doc_id"] for r in index.vectors.collect())
    return documents, vectors, count.head()[0]


def test_delete_by_id(spark, current):
    ids = spark.createDataFrame([(1,), (1,), (9,), (5,)], "id long")
    assert kept(ix.delete_by_id(current, ids)) == ([2, 7], [2], 1)


def test_delete_by_domain_is_a_substring_of_the_path(current):
    assert kept(ix.delete_by_domain(current, "a.org")) == ([2], [2, 9], 2)
    assert kept(ix.delete_by_domain(current, "A.org")) == ([1, 2, 7], [1, 2, 9], 0)


def test_prune(current):
    rules = ScanRules(base="/d/", blocked_domains=("b.org",))
    assert kept(ix.prune_disallowed_domains(current, rules)) == ([1, 7], [1, 9], 1)
    assert kept(ix.prune_skipped_files(current, rules)) == ([1, 2], [1, 2, 9], 1)
    dangling = ix.prune_dangling_vectors(current)
    assert sorted(r["doc_id"] for r in dangling.vectors.collect()) == [1, 2]


def test_backfill(current):
    documents, count = ix.backfill_urls(current.documents, "/d/")
    assert rows(documents.select("id", "url")) == [
        (1, "u1"), (2, "https://b.org/2"), (7, "https://a.org.uk/genindex"),
    ]
    assert count.head()["filled_documents"] == 2


def test_save_embeddings(spark, current):
    new = spark.createDataFrame([(2, [5.0]), (3, [6.0])], ix.VECTORS_SCHEMA)
    assert rows(ix.save_embeddings(current.vectors, new)) == [(1, [1.0]), (2, [5.0]), (3, [6.0]), (9, [9.0])]


def test_documents_from_before_there_was_a_url(spark, current, tmp_path):
    current.documents.drop("url").write.parquet(str(tmp_path / "old"))
    old = read_legacy_documents(spark, str(tmp_path / "old"))
    assert old.columns == list(ix.DOCUMENT_COLUMNS)
    assert {r["url"] for r in old.collect()} == {None}
    assert ix.backfill_urls(old, "/d/")[1].head()[0] == 3


def test_save_embeddings_with_repeated_ids(spark, current):
    new = spark.createDataFrame([(2, [5.0], 2), (2, [7.0], 1), (3, [6.0], 1), (3, [6.0], 1)], "doc_id long, embedding array<float>, seq int")
    kept = [(1, [1.0]), (3, [6.0]), (9, [9.0])]
    assert rows(ix.save_embeddings(current.vectors, new, "seq")) == sorted([*kept, (2, [5.0])])
    assert rows(ix.save_embeddings(current.vectors, new)) == sorted([*kept, (2, [7.0])])


def test_contracts(spark):
    nan, inf = float("nan"), float("-inf")
    documents = spark.createDataFrame(
        [(1, "p", "u", "t", "a"), (None, "p", None, "t", "a"), (2, "", "u", "t", "a"), (3, None, "u", "t", "a"), (4, "p", "u", None, "a"), (5, "p", "u", "t", None), (6, "p", "u", "", ""), (7, None, None, None, None)],
        ix.DOCUMENTS_SCHEMA,
    )
    good, bad = split_documents(documents, Contract())
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 6]
    reasons = {(r["id"], r["reason"]) for r in bad.collect()}
    assert reasons == {(None, "no_id"), (2, "no_path"), (3, "no_path"), (4, "no_text"), (5, "no_category"), (7, "no_path")}
    good, bad = split_documents(documents, Contract(categories=("", "b")))
    assert [r["id"] for r in good.collect()] == [6] and (1, "unknown_category") in {(r["id"], r["reason"]) for r in bad.collect()}

    vectors = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, None), (5, [1.0, None]), (6, [1.0, nan]), (7, [inf, 1.0]), (None, [1.0, 2.0])], ix.VECTORS_SCHEMA
    )
    good, bad = split_vectors(vectors, Contract(dim=2))
    assert [r["doc_id"] for r in good.collect()] == [1]
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {
        (2, "wrong_dimension"), (3, "wrong_dimension"), (4, "no_vector"), (5, "null_number"), (6, "not_finite"), (7, "not_finite"), (None, "no_id"),
    }
    assert sorted(r["doc_id"] for r in split_vectors(vectors, Contract())[0].collect()) == [1, 2, 3]


def test_snapshots_keep_every_category(spark, tmp_path):
    names = ["", None, "a", "c-a", "x/y=z %", "__HIVE_DEFAULT_PARTITION__"]
    documents = spark.createDataFrame([(i, f"p{i}", None, "t", name) for i, name in enumerate(names)], ix.DOCUMENTS_SCHEMA)
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(len(names))], ix.VECTORS_SCHEMA)
    write_index(ix.Index(documents, vectors), str(tmp_path / "all"))
    stored = read_index(spark, str(tmp_path / "all"))
    assert [r["category"] for r in stored.documents.orderBy("id").collect()] == names
    assert [r["category"] for r in read_corpus(spark, str(tmp_path / "all")).orderBy("doc_id").collect()] == names
    write_index(ix.Index(documents, vectors), str(tmp_path / "some"), Contract(dim=1, categories=("", "a")))
    assert rows(read_index(spark, str(tmp_path / "some")).documents.select("id")) == [(0,), (2,)]
    assert sorted(r["id"] for r in read_rejected(spark, str(tmp_path / "some")).collect()) == [1, 3, 4, 5]


def test_stored_pages_are_read_by_category(spark, tmp_path):
    given = [
        ("/m/en/a.org/1", "one", 1), ("/m/en/b.org/2", None, 2), ("/m/fr/a.org/1", "three", 3), ("/m/fr/a.org/1", "three", 3), ("/other/fr/x", "no", 4), ("/m/top", "file", 5), (None, "null", 6), ("/m//d.org/x", "none", 7),
    ]
    pages = spark.createDataFrame(given, "path string, raw string, seq long")
    folder = str(tmp_path / "pages")
    write_pages(pages, folder, "/m/", hosts=4)
    order = lambda found: sorted(map(str, found))
    assert order(map(tuple, read_pages(spark, folder).collect())) == order(given)
    french = read_pages(spark, folder, "FR", ("en", "fr"))
    assert rows(french.select("seq")) == [(3,), (3,)]
    text = plan(french)
    assert "PartitionFilters: [isnotnull(category_key" in text and "c-fr" in text.split("PartitionFilters")[1][:120]
    with pytest.raises(ValueError, match="unknown category"):
        read_pages(spark, folder, "xx", ("en", "fr"))
