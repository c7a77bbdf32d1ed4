import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from pageloom.llm import filter_audit, queries
from tests.llm import cases

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
LABELS = "doc_id long, quality int, toxic int"


def brute_force(documents, labels):
    """The rows of the audit, by walking every document through every order."""
    first = {}
    for d in documents:
        if d["doc_id"] is not None:
            text = d["text"] or ""
            first[text] = min(first.get(text, d["doc_id"]), d["doc_id"])
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    classes = defaultdict(Counter)
    for d in documents:
        text, number = d["text"] or "", d["doc_id"]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(
            name
            for name, failed in zip(
                "ABCDE",
                (
                    len(words) < 200,
                    100 * len(set(words)) < 50 * len(words),
                    100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                    re.search(r"[#$%&*|]", text),
                    number is not None and first[text] < number,
                ),
                strict=True,
            )
            if failed
        )
        known = number is not None
        classes[d["source"] or ""][fails, known and number in good, known and number in toxic] += 1
    rows = {}
    for part, groups in classes.items():
        for order in permutations("ABCDE"):
            alive = groups
            for step, name in enumerate(order, 1):
                left = Counter({k: n for k, n in alive.items() if name not in k[0]})
                gone = alive - left
                fail = sum(n for k, n in groups.items() if name in k[0])
                rows[part, "".join(order), step] = [
                    left.total(), gone.total(), fail - gone.total(), sum(n for k, n in groups.items() if k[0] == name),
                    sum(n for k, n in gone.items() if k[1]), sum(n for k, n in gone.items() if k[2]),
                ]
                alive = left
    shapley = Counter()
    for (part, order, step), row in rows.items():
        shapley[part, order[step - 1]] += row[1]
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


def found(frame):
    return {(r["part"], r["filter_order"], r["step"]): (*[r[c] for c in COLUMNS], r["shapley"]) for r in frame.collect()}


def test_documents(spark, sf):
    docs = cases.documents(spark, sf).collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    got = found(queries.QUERIES["op11_filter_audit"](spark, sf))
    assert got == brute_force(docs, labels)
    assert len(got) == 600 * len({d["source"] for d in docs})


def test_hard_documents(spark):
    docs = cases.hard_documents(spark).unionByName(cases.hard_documents(spark))
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (4, 0, 1), (4, 0, 1), (77, 1, 1)], LABELS
    )
    flags = filter_audit.document_flags(docs, labels)
    assert flags.count() == docs.count()
    assert found(filter_audit.audit(flags)) == brute_force(docs.collect(), labels.collect())


def test_limits_of_the_filters(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words * 2), " ".join(words * 2)[:-1], " ".join([*words, *words[:99], words[0]]) + " x y", "A" + "b" * 49, "A" + "b" * 48, "é" * 49 + "A"]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    empty = spark.createDataFrame([], LABELS)
    assert found(filter_audit.audit(filter_audit.document_flags(docs, empty))) == brute_force(docs.collect(), [])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], LABELS)
    flags = filter_audit.document_flags(cases.empty_documents(spark), empty)
    assert filter_audit.audit(flags).count() == 0


def test_counts_beyond_32_bits():
    steps = filter_audit.steps("ABCDE")
    n = 2**62
    total = n * filter_audit.packed("ABCDE", 0b10001, (True, False)) + (n - 1) * filter_audit.packed("ABCDE", 0, (False, True))
    rows = filter_audit.unpacked(total, "ABCDE", 2)
    assert len(steps) == len(rows) == 600
    for (order, step, name), row in zip(steps, rows.tolist(), strict=True):
        before = set(order[: step - 1])
        removed = name in "AE" and not before & set("AE")
        kept = n - 1 + (0 if removed or before & set("AE") else n)
        assert row == [kept, n * removed, n * (name in "AE" and not removed), 0, n * removed, 0]


def test_other_filters_and_marks(spark):
    flags = spark.createDataFrame([("p", 1, True), ("p", 3, False), ("p", 0, True), ("q", 2, True)], "part string, mask int, old boolean")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["old_lost"]) for r in filter_audit.audit(flags, "XY", ["old"]).collect()}
    assert got == {
        ("p", "XY", 1): (1, 2, 0, 1), ("p", "XY", 2): (1, 0, 1, 0), ("p", "YX", 1): (2, 1, 0, 0), ("p", "YX", 2): (1, 1, 1, 1),
        ("q", "XY", 1): (1, 0, 0, 0), ("q", "XY", 2): (0, 1, 0, 1), ("q", "YX", 1): (0, 1, 0, 1), ("q", "YX", 2): (0, 0, 0, 0),
    }
    for wrong in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            filter_audit.audit(flags, wrong, ["old"])
