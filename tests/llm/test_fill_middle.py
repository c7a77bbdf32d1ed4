import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.llm import common, fill_middle, queries
from tests.llm import cases


def brute_force(text, number):
    """The output by listing all units."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if number is None else number}".encode()).hexdigest()
    one, two, three, four = (int(digest[at : at + 8], 16) for at in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or three % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if four % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    choose = random.Random(9)
    kinds = ["ab", "abc é日\n", "a", " ", "<PSM>", "aZ@[`{", "x y"]
    made = ["".join(choose.choices(choose.choice(kinds), k=choose.randrange(6000))) for _ in range(150)]
    made += ["", "a", "é", "a" * 20_000, " " * 20_000, "é" * 9000 + "a" * 9000, "<P>", "a<S>b", "<M", "\udfff"]
    shared = "".join(choose.choices("abc de.", k=20_000))
    return [*made, *[choose.choice(made[:50])[:700] + shared + str(i) for i in range(30)]]


def test_every_text():
    memo = fill_middle.Memo()
    for number, text in enumerate(texts()):
        assert fill_middle.rearranged(text, number, memo) == brute_force(text, number)
    assert memo.hits > memo.misses


def test_every_unit_boundary():
    text = "".join(random.Random(1).choices("aaaaaaaaaaab é", k=9000)) + "z" * 5000 + "1"
    units = fill_middle.Units(text, fill_middle.Memo())
    ends = [0, *[m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]]
    assert len(units.begins) > 10 and any(units.goes_on)
    assert units.n == len(ends) - 1 and [units.offset(k) for k in range(units.n + 1)] == ends


def test_a_full_memo_forgets():
    memo = fill_middle.Memo(most_chars=20_000)
    for number, text in enumerate(texts()):
        assert fill_middle.rearranged(text, number, memo) == brute_force(text, number)
        assert sum(len(chunk) for kept in (memo.young, memo.old) for chunk, _ in kept.values()) <= 20_000


def test_equal_hashes_of_unlike_chunks(monkeypatch):
    monkeypatch.setattr(fill_middle, "hash", lambda chunk: 1, raising=False)
    memo = fill_middle.Memo()
    for number, text in enumerate(texts()):
        assert fill_middle.rearranged(text, number, memo) == brute_force(text, number)


def test_chunks_follow_the_content(monkeypatch):
    text = "".join(random.Random(2).choices("abcdefgh ", k=200_000))
    ends = list(fill_middle.chunk_ends(text))
    chunks = {text[a:b] for a, b in zip([0, *ends], ends)}
    assert ends[-1] == len(text) and all(b - a <= fill_middle.MOST for a, b in zip([0, *ends], ends))
    for moved in ("x" * 77 + text, text[:90_000] + "inserted" + text[90_000:]):
        others = list(fill_middle.chunk_ends(moved))
        assert len(chunks & {moved[a:b] for a, b in zip([0, *others], others)}) > 0.95 * len(chunks)
    monkeypatch.setattr(fill_middle, "BLOCK", 1000)
    assert list(fill_middle.chunk_ends(text)) == ends


def test_hard_documents(spark):
    docs = cases.hard_documents(spark).withColumn("fim_form", F.lit("clash"))
    out = fill_middle.transform(docs)
    kept = [c for c in docs.columns if c != "fim_form"]
    assert sorted(map(str, out.select(*kept).collect())) == sorted(map(str, docs.select(*kept).collect()))
    for r in out.withColumn("back", fill_middle.restored(F.col("fim_text"), F.col("fim_form"))).collect():
        assert (r["fim_n"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_text"]) == brute_force(r["text"] or "", r["doc_id"])
        assert r["back"] == (r["text"] or "")
    assert fill_middle.transform(cases.empty_documents(spark)).count() == 0


def test_documents(spark, sf):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {d["doc_id"]: (*(made := brute_force(d["text"] or "", d["doc_id"]))[:4], sha(made[4]), sha(d["text"] or "")) for d in cases.documents(spark, sf).collect()}
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in queries.QUERIES["op13_fill_middle"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("most", [1, 100, 10_000, None])
def test_slices_hold_all_rows(most):
    import pyarrow as pa

    batch = pa.record_batch({"i": list(range(2500)), "t": ["x" * (i % 7) for i in range(2500)]})
    parts = list(common.slices(batch, most))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows <= common.SLICE and (most is None or p.num_rows == 1 or p.nbytes <= most) for p in parts)
