import hashlib
import random

from pyspark.sql import functions as F

from pageloom.llm import queries, syncmers
from tests.helpers import plan
from tests.llm import cases


def edited(texts):
    """By (id, text) in the order of ids."""
    out = []
    for i, (_, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        q = len(text) // 4
        out.append(text[: len(text) - q] + after[:q])
    return out


def test_documents(spark, sf):
    rows = queries.QUERIES["op4_syncmers"](spark, sf).orderBy("doc_id").collect()
    texts = [(r[0], r[1] or "") for r in cases.documents(spark, sf).select("doc_id", "text").orderBy("doc_id").collect()]
    want = [(t[0], len(t[1]), hashlib.sha256(e.encode()).hexdigest()) for t, e in zip(texts, edited(texts), strict=True)]
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows] == want
    same = {}
    for (_, text), row in zip(texts, rows, strict=True):
        assert same.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert len(set(same.values())) == len(same)
    long = [r for r in rows if r["n_chars"] > 2000]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5
    assert sum(r["near_next"] for r in long) / len(long) < 0.2




def test_anchors_from_the_definition(spark):
    choose = random.Random(5)
    texts = [" ".join(choose.choice("ab cd ef gh".split()) + str(choose.randrange(9)) for _ in range(n)) for n in (7, 8, 9, 40, 200)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    units = F.regexp_extract_all("text", F.lit(syncmers.UNITS), F.lit(0))
    inner = F.transform(F.sequence(F.lit(1), F.size(units) - 1), lambda i: F.xxhash64(
        F.xxhash64(F.element_at(units, i)), F.xxhash64(F.element_at(units, i + 1))))
    for row in frame.select("text", inner.alias("h"), syncmers.anchors(F.col("text")).alias("a")).collect():
        h, w = row["h"], syncmers.INNER
        want = [i for i in range(len(h) - w + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])]
        assert [a["position"] for a in row["a"]] == want


def test_anchors_do_not_depend_on_their_surroundings(spark):
    text = " ".join(f"w{i * i % 97}" for i in range(100))
    rows = [(text, f"zz yy {text} qq")]
    found = spark.createDataFrame(rows, "a string, b string").select(
        syncmers.shared_anchors(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("s"),
        F.size(syncmers.anchors(F.col("a"))).alias("n"),
    ).head()
    assert len(found["s"]) == found["n"] and {x["shift"] for x in found["s"]} == {2}


def test_hard_documents(spark):
    docs = cases.hard_documents(spark)
    rows = syncmers.fingerprints(docs).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"]: r["hashes"] for r in rows if r["text"] == ""} == {3: [], 4: [], None: []}
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[9]["next"]["text"] in ("no id", "") and by_id[8]["next"]["text"].startswith("<|")
    assert by_id[7]["edited"] == "é" * 2250 + by_id[8]["text"][:750]
    assert syncmers.fingerprints(cases.empty_documents(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert syncmers.fingerprints(one).head()["edited"] == "abcdefab"



def test_plan_is_native_and_shuffles_texts_once(spark, sf):
    text = plan(queries.QUERIES["op4_syncmers"](spark, sf))
    assert not any(kind in text for kind in ("Python", "Pandas", "Arrow", "ExistingRDD"))
    assert text.count("\n(") and text.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 1
