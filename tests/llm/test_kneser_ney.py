import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import kneser_ney, queries
from tests.llm import cases


def brute(pairs, classes):
    """Interpolated modified Kneser-Ney from pairs of ids, by the definition."""

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
        safe = [min(max(d, 0.1), 0.95 * k) for k, d in enumerate(raw, 1)]
        return lambda c: safe[min(c, 3) - 1]

    counts = Counter(pairs)
    follows = Counter(v for _, v in counts)
    d, e = discounts(counts), discounts(follows)
    total = sum(follows.values())
    rest = sum(map(e, follows.values())) / total
    word = defaultdict(lambda: rest / classes, {v: (a - e(a)) / total + rest / classes for v, a in follows.items()})
    sums, left = Counter(), Counter()
    for (u, _), c in counts.items():
        sums[u] += c
        left[u] += d(c)

    def p(u, v):
        if u not in sums:
            return word[v]
        seen = (counts[u, v] - d(counts[u, v])) / sums[u] if (u, v) in counts else 0.0
        return seen + left[u] / sums[u] * word[v]

    return p


def test_probabilities(spark):
    pairs = [(i * i % 7, i * 3 % 11) for i in range(200)] + [(1, 2)] * 5 + [(3, 3)]
    rows = [("x", u, v, n) for (u, v), n in Counter(pairs).items()]
    found = kneser_ney.probabilities(spark.createDataFrame(rows, "language string, u long, v long, n long"), 12)
    p = brute(pairs, 12)
    seen = [r for r in found.collect() if r["u"] >= 0 and r["v"] >= 0]
    assert len(seen) == len(rows)
    assert all(math.isclose(math.exp(r["logp"]), p(r["u"], r["v"]), rel_tol=1e-9) for r in seen)
    assert all(math.isclose(sum(p(u, v) for v in range(12)), 1, rel_tol=1e-9) for u in range(8))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_kneser_ney"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == cases.documents(spark, sf).count()
    good = [rows[r["doc_id"]]["good"] for r in labels if r["quality"] == 1]
    bad = [rows[r["doc_id"]]["good"] for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_hard_documents(spark):
    docs = cases.hard_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (5, 1, 1), (7, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        found = kneser_ney.with_quality(docs, kneser_ney.fit(docs, own))
        assert found.columns == [*docs.columns, "log_perplexity", "good"]
        assert found.count() == docs.count()
        assert found.where(F.trim(F.coalesce("text", F.lit(""))) == "").where("not good").count() == 0
    empty = cases.empty_documents(spark)
    assert kneser_ney.with_quality(empty, kneser_ney.fit(empty, labels)).count() == 0


def test_pairs_of_a_worker():
    code = np.array([1 << kneser_ney.CODE_BITS | 2, 3 << kneser_ney.CODE_BITS | 0], np.int32)
    pairs = kneser_ney.Pairs(code, np.array([-1, -2], np.float32), np.full(5, -10, np.float32), np.arange(5, dtype=np.float32))
    assert pairs.of(np.array([1, 2, 3, 0, 4], np.int32)).tolist() == [-1, -7, -2, -6]


def test_columns_of_the_input_stay(spark):
    docs = cases.hard_documents(spark, extra=False).withColumns({n: F.lit("x") for n in ("n_words", "judged", "good", "log_perplexity")})
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    kept = kneser_ney.keep_good(docs, kneser_ney.fit(docs, labels))
    assert kept.schema == docs.schema
    assert kept.where("n_words = 'x' and judged = 'x' and good = 'x' and log_perplexity = 'x'").count() == kept.count() > 0


def test_labels_are_bounded(spark, sf):
    docs = cases.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    few = kneser_ney.trusted_documents(docs, labels, max_labels=20).count()
    assert 0 < few < 30 < kneser_ney.trusted_documents(docs, labels).count()


def test_all_labels_count(spark, sf, monkeypatch):
    docs = cases.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    for most in (kneser_ney.BROADCAST_LABELS, 5):
        monkeypatch.setattr(kneser_ney, "BROADCAST_LABELS", most)
        assert {r["doc_id"] for r in kneser_ney.trusted_documents(docs, labels).collect()} == good


def test_every_language_has_a_model(spark):
    choose = random.Random(3)
    languages = [f"l/{i}" for i in range(12)] + [""]
    rows = [
        (i, " ".join(f"{lang}w{choose.randrange(6)}" for _ in range(30)), lang)
        for i, lang in enumerate(languages[j % len(languages)] for j in range(600))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    model = kneser_ney.fit(docs, labels)
    assert set(model.vocabulary) == {*languages, kneser_ney.OTHERS}
    assert set(model.thresholds) == set(model.medians) == set(languages)
    scores = {r["doc_id"]: r["log_perplexity"] for r in kneser_ney.with_quality(docs, model).collect()}
    for lang in languages[::6]:
        own = docs.where(F.col("lang") == lang)
        alone = kneser_ney.with_quality(own, kneser_ney.fit(own, labels)).collect()
        assert all(math.isclose(r["log_perplexity"], scores[r["doc_id"]], rel_tol=1e-9) for r in alone)


@pytest.mark.parametrize(("word", "kind"), [("12", 0), ("!!", 1), ("abc", 2), ("ABC", 3), ("Abc", 4), ("a1", 5), ("ABC!!", 11), ("abcdefghijklmnop", 6)])
def test_shapes(word, kind):
    assert kneser_ney.shape(word, None) == kind


def words_of(choose, n):
    """Words of which most are rare, in all shapes."""
    return [choose.choice(("the", "of", f"w{choose.randrange(4000)}", f"Rare{'abc'[choose.randrange(3)]}{choose.randrange(9000)}!!")) for _ in range(n)]


def test_every_word_of_trusted_texts_counts(spark, monkeypatch):
    choose = random.Random(5)
    rows = [(i, " ".join(words_of(choose, choose.randrange(1, 90))), "en") for i in range(400)] + [(400, "the never, seen 17 w1 of of w2 w2 never, never,", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 300").selectExpr("doc_id", "1 as quality", "0 as toxic")
    held_out = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT)) == 0).collect()}
    trained = [["", *text.split()] for i, text, _ in rows if i < 300 and i not in held_out]
    known = Counter(word for words in trained for word in words[1:])
    assert len(known) > 3000
    pairs = [pair for words in trained for pair in zip(words, words[1:])]
    p = brute(pairs, len(known) + 1)
    before = Counter(v for _, v in set(pairs))
    shapes = Counter(kneser_ney.shape(word, None) for word, n in before.items() if n == 1)

    seen = Counter(pairs)
    shapes[kneser_ney.REPEATED] += sum(u == v and n == 1 for (u, v), n in seen.items())

    def chance(u, v):
        if v in known and (u != v or (u, v) in seen):
            return p(u, v)
        return p(u, "never") * (shapes[kneser_ney.shape(v, u)] + 1) / (sum(shapes.values()) + kneser_ney.SHAPES)

    want = {i: -sum(math.log(chance(*pair)) for pair in zip(["", *text.split()], text.split())) / len(text.split()) for i, text, _ in rows}
    # Stored in many parts, read for many groups and in small pieces, the same comes out.
    for sizes in ({}, {"PART_CHARS": 1000, "GROUP_BYTES": 2000, "LOAD_ROWS": 7, "FLUSH": 50, "MEMO": 20}):
        for name, size in sizes.items():
            monkeypatch.setattr(kneser_ney, name, size)
        model = kneser_ney.fit(docs, labels)
        assert model.vocabulary == {"en": len(known), kneser_ney.OTHERS: 0}
        scores = {r["doc_id"]: r["log_perplexity"] for r in kneser_ney.with_quality(docs, model).collect()}
        assert all(math.isclose(scores[i], want[i], rel_tol=1e-9) for i in want)


def test_invented_words_are_not_good(spark):
    choose = random.Random(6)
    rows = [(i, " ".join(words_of(choose, 60)), "en") for i in range(300)]
    rows += [(300 + i, " ".join(f"invented{choose.randrange(10**9)}" for _ in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 300").selectExpr("doc_id", "1 as quality", "0 as toxic")
    good = {r["doc_id"]: r["good"] for r in kneser_ney.with_quality(docs, kneser_ney.fit(docs, labels)).collect()}
    assert sum(good[i] for i in range(300)) >= 290 and not any(good[i] for i in range(300, 320))
