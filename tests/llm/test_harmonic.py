import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from pageloom.llm import harmonic, queries
from pageloom.llm.chunk_encoder import load_tokenizer
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    ids = load_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 1], "<u4")


def padded(lengths, capacity):
    return sum(n if n & (n - 1) == 0 else capacity for n in lengths)


def check(pieces, texts, capacity=2048):
    """Every id in one piece, sequences without gaps and within the capacity; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    sizes = []
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        sizes.append(at)
    return 1 - sum(sizes) / padded(sizes, capacity) if sizes else 0.0


def test_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in cases.documents(spark, sf).collect()}
    assert check(queries.QUERIES["op5_harmonic"](spark, sf).collect(), texts) < 0.005


def test_hard_documents(spark):
    docs = cases.hard_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    from pyspark.sql import functions as F

    for capacity in (1, 64, 2048):
        packed = harmonic.pack(docs, PATH, capacity=capacity).withColumn("ids_crc32", F.crc32("ids"))
        check(packed.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, capacity)
    every = harmonic.pack(cases.hard_documents(spark), PATH)
    assert every.where("doc_id is null").agg(F.sum("length")).head()[0] == len(ids_of("no id")) + 1
    assert harmonic.pack(cases.empty_documents(spark), PATH).count() == 0


def test_classes_hold_a_fixed_count():
    packer = harmonic.Packer(0)
    rows = []
    for doc, n in enumerate([2048, 700, 683, 682, 500, 64, 63, 1, 5000] * 400):
        rows += packer.add(doc, np.zeros(n, np.uint32))
    sequences = defaultdict(list)
    for row in rows:
        sequences[row[4]].append(len(row[2]))
    for lengths in sequences.values():
        kinds = {2048 // n for n in lengths}
        assert kinds == {len(lengths)}


@pytest.mark.parametrize("n", [*range(70), 1023, 1024, 2047, 2048, 2049, 10_000])
def test_cut_lengths(n):
    lengths = harmonic.cut_lengths(n)
    assert sum(lengths) == n and all(0 < x <= 2048 for x in lengths)


def test_capacity_is_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        harmonic.pack(cases.empty_documents(spark), PATH, capacity=1000)


def test_large_ids_beside_a_missing_one(spark):
    big = 2**53 + 1  # no double has this value
    docs = spark.createDataFrame([(big, "one two"), (None, "three")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in harmonic.pack(docs, PATH).collect()} == {big, None}


def test_rows_of_a_worker_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(harmonic, "BATCH", 3)
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(40)], "doc_id long, text string")
    packed = harmonic.pack(docs, PATH).selectExpr("*", "crc32(ids) as ids_crc32")
    check(packed.collect(), {i: "a b c " * i for i in range(40)})
