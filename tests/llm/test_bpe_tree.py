import hashlib
import random
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pageloom.llm import bpe_tree, queries
from pageloom.llm.chunk_encoder import ChunkEncoder, load_tokenizer, tree_encode
from tests.helpers import plan
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def direct(text):
    return load_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_documents(spark, sf):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_bpe_tree"](spark, sf).collect()}
    docs = cases.documents(spark, sf).collect()
    assert len(got) == len(docs)
    for row in docs:
        ids = direct(row["text"])
        text = load_tokenizer(PATH).decode(ids, skip_special_tokens=False)
        one = got[row["doc_id"]]
        assert one["n_tokens"] == len(ids)
        assert one["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert one["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("long_chars", [bpe_tree.LONG_CHARS, 5])
def test_hard_documents(spark, long_chars):
    docs = cases.hard_documents(spark)
    found = bpe_tree.encode(docs, PATH, long_chars=long_chars, leaf_chars=7 if long_chars == 5 else 1000)
    assert set(found.columns) == set(docs.columns)
    got = sorted((str(r["doc_id"]), str(r["text"]), list(np.frombuffer(r["ids"], "<u4"))) for r in found.collect())
    assert got == sorted((str(r["doc_id"]), str(r["text"]), direct(r["text"])) for r in docs.collect())


def test_long_texts_behind_a_shuffle_and_a_join(spark):
    choose = random.Random(6)
    rows = [(i, "".join(choose.choices("abc de", k=choose.randrange(300, 900)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbers = spark.range(70).select(F.col("id").alias("doc_id"), F.rand().alias("noise"))
    want = {(i, text): direct(text) for i, text in rows}
    # Every evaluation of the second one sees other partitions.
    for given in (docs.repartition("doc_id"), docs.repartition(7, F.rand()), docs.join(numbers.hint("merge"), "doc_id").drop("noise")):
        found = bpe_tree.encode(given, PATH, long_chars=100, leaf_chars=50).collect()
        assert len(found) == len(rows)
        assert {(r["doc_id"], r["text"]): list(np.frombuffer(r["ids"], "<u4")) for r in found} == want


def test_pieces_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(bpe_tree, "TASK_CHARS", 1000)
    docs = spark.createDataFrame([(i, "ab c" * 1000) for i in range(5)], "doc_id long, text string").coalesce(1)
    text = plan(bpe_tree.encode(docs, PATH, long_chars=100, leaf_chars=50))
    assert "REPARTITION_BY_NUM" in text and "20)" in text.split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]


def test_no_documents(spark):
    assert bpe_tree.decode(bpe_tree.encode(cases.empty_documents(spark), PATH), PATH).count() == 0
    assert bpe_tree.encode(cases.empty_documents(spark), PATH, decoded=True).count() == 0


def test_decoding_in_the_same_pass(spark):
    docs = cases.hard_documents(spark)
    both = bpe_tree.encode(docs, PATH, long_chars=100, decoded=True)
    again = bpe_tree.decode(both.withColumnRenamed("decoded", "first"), PATH)
    assert again.where("decoded <> first").count() == 0 and again.count() == docs.count()


ALPHABETS = ("ab", "aAbBé", "the quick'sre", "!'st.x1 ", "áöe J̌İ", "漢字かなab", "각가a", "<|endoftext|>ab ", "\x1c\x1d a\x85\xa0b")


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_joins_equal_direct_encoding(alphabet):
    choose = random.Random(alphabet)
    tokenizer = load_tokenizer(PATH)
    for _ in range(60):
        text = "".join(choose.choice(alphabet) for _ in range(choose.randrange(1, 700)))
        if "|" in alphabet:
            text = text.replace("a", "<|endoftext|>")
        want = direct(text)
        for leaf in (1, 3, 50, 200):
            assert tree_encode(tokenizer, text, leaf)[:, 0].tolist() == want
        assert ChunkEncoder(tokenizer).encode([text, "", text])[2].tolist() == want


def test_long_unsplit_text():
    choose = random.Random(1)
    text = "".join(choose.choice("abcdeht") for _ in range(60_000))
    assert tree_encode(load_tokenizer(PATH), text, 5000)[:, 0].tolist() == direct(text)
    assert ChunkEncoder(load_tokenizer(PATH)).encode([text])[0].tolist() == direct(text)


def test_memo_starts_afresh(monkeypatch):
    monkeypatch.setattr("pageloom.llm.chunk_encoder.MEMO", 3)
    encoder = ChunkEncoder(load_tokenizer(PATH))
    for text in ("a b c d e f", "c d x y z", "", "a b"):
        assert encoder.encode([text])[0].tolist() == direct(text)


def test_a_memo_of_its_own_is_kept_to():
    encoder = ChunkEncoder(load_tokenizer(PATH), 5)
    for text in (" ".join(f"w{i}x" for i in range(20)), "c d x y z", "", "a w1x b", "a b"):
        assert encoder.encode([text])[0].tolist() == direct(text)
        assert len(encoder) <= 5 + len(text.split())
