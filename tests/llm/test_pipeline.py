import random
from collections import Counter

import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from pageloom.llm import chunk_encoder, common, feistel, harmonic, kneser_ney
from pageloom.llm.chunk_encoder import load_tokenizer
from tests.llm import cases
from tests.llm.test_signature_tree import expected


def test_stages_against_plain_python(spark, sf):
    docs, rows = cases.documents(spark, sf), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        after = {r["doc_id"]: r.asDict() for r in out.collect()}
        if name == "near_copies":
            roots = {doc: root for doc, _, root in expected([(i, r["text"]) for i, r in before.items()])}
            assert set(after) == {doc for doc, root in roots.items() if doc == root} and len(after) < len(before)
        elif name == "pseudonyms":
            assert {i: r["text"] for i, r in after.items()} == {i: feistel.replace_all(r["text"])[0] for i, r in before.items()}
        else:
            labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
            assert not any(r["quality"] == 0 and r["doc_id"] in after for r in labels)
            assert sum(r["quality"] == 1 and r["doc_id"] in after for r in labels) >= 0.97 * sum(r["quality"] == 1 for r in labels)
        docs, rows = spark.createDataFrame(out.collect(), docs.schema), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    lengths = Counter()
    for p in packed:
        lengths[p["doc_id"]] += p["length"]
    tokenizer = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert lengths == {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in rows.items()}


def test_run_and_registration(spark, sf):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and whole.count() > 0


def test_hard_documents(spark, sf):
    for docs in (cases.hard_documents(spark, extra=False), cases.empty_documents(spark)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
        assert docs.select("doc_id").distinct().count() > 0 or n == 0


def test_stages_with_python_run_in_small_batches(spark, sf, monkeypatch):
    docs = spark.createDataFrame(
        [(i, "en" if i % 3 else None, None if i == 7 else f"w{i} one two a@b{i}.org three " * (i % 5)) for i in range(60)],
        "doc_id long, lang string, text string",
    )
    before, seen = spark.conf.get(common.BATCH_CONF), {}
    stored = corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda frame, name: (seen.update({name: spark.conf.get(common.BATCH_CONF)}), stored(frame, name))[1])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert spark.conf.get(common.BATCH_CONF) == before
        # No work in Python is left for whoever reads the rows.
        assert "MapIn" not in docs._jdf.queryExecution().executedPlan().toString(), name
    assert seen == dict.fromkeys(("quality", "pseudonyms", "packing"), str(common.BATCH_ROWS))


def test_packing_remembers_few_chunks(spark, sf, monkeypatch):
    made, limits = harmonic.pack, []
    monkeypatch.setattr(harmonic, "pack", lambda *a, **b: (limits.append(b), made(*a, **b))[1])
    corpus_pipeline.packed_sequences(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), sf)
    assert limits[0]["memo"] < chunk_encoder.MEMO and limits[0]["slice_chars"] < chunk_encoder.SLICE_CHARS


def test_words_that_no_trusted_text_has_do_not_pass(spark):
    choose = random.Random(7)
    rows = [(i, " ".join(f"w{choose.randrange(4000)}" for _ in range(80)), "en") for i in range(300)]
    rows += [(300 + i, " ".join(f"x{choose.randrange(10**9)}" for _ in range(80)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = kneser_ney.fit(docs, docs.where("doc_id < 300").selectExpr("doc_id", "1 as quality", "0 as toxic"))
    kept = {r["doc_id"] for r in kneser_ney.keep_good(docs, model).collect()}
    assert max(kept) < 300 and len(kept) >= 290
