import random
import re
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pageloom import session
from pageloom.llm import common, kneser_ney, oracles, queries, signature_tree
from tests.helpers import plan
from tests.llm import cases


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else {tuple(words)}


def expected(rows):
    """By (id, text) with different ids."""
    sets = {doc: shingles(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            u, v = sorted((root(a), root(b)))
            parent[v] = u
    return sorted((doc, len(s), root(doc)) for doc, s in sets.items())


def found(frame):
    return sorted(map(tuple, signature_tree.similar_documents(frame).collect()))


def test_sql(spark, sf):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{Path(sf) / 'documents.parquet'}'")
    want = connection.execute(oracles.ORACLES["op9_signature_tree"]).fetchall()
    got = queries.QUERIES["op9_signature_tree"](spark, sf).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def cluster_rows():
    choose = random.Random(4)
    rows, doc = [], 0
    passage = [f"p{i}" for i in range(60)]
    for size in (1, 2, 5, 40):
        for n in (5, 9, 14, 60, 300):
            base = [f"w{choose.randrange(3000)}" for _ in range(n)]
            for _ in range(size):
                words = list(base)
                for _ in range(choose.randrange(0, 1 + n // 40)):
                    words[choose.randrange(n)] = f"e{choose.randrange(10**6)}"
                if choose.random() < 0.3:
                    words = words + passage[: choose.randrange(60)]
                rows.append((doc := doc + 1, " ".join(words)))
    # Just linked and just not: 8 of 10 runs, and 7 of 9.
    rows += [(5000, "a b c d e f g h i j k l m"), (5001, "a b c d e f g h i j k l x"), (5002, "a b c d e f g h i j k y")]
    choose.shuffle(rows)
    return rows


def test_clusters_and_passages(spark, monkeypatch):
    rows = cluster_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame) == expected(rows)
    monkeypatch.setattr(signature_tree, "TILE", 8)  # many tiles in a band; workers keep their own leaf size
    monkeypatch.setattr(signature_tree, "BROADCAST_KEYS", 1)
    assert found(frame) == expected(rows)


def test_hard_documents(spark):
    docs = cases.hard_documents(spark)
    got = signature_tree.similar_documents(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: tuple(r) for r in got if r["doc_id"] is not None}
    assert by_id[1] == (1, 3, 1) and by_id[2] == (2, 3, 1) and by_id[3] == (3, 0, 3) and by_id[4] == (4, 0, 4) and by_id[6] == (6, 0, 6)
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    kept = signature_tree.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "None", "None"])
    assert signature_tree.similar_documents(cases.empty_documents(spark)).count() == 0
    assert signature_tree.keep_one(cases.empty_documents(spark)).count() == 0


def test_trees_lose_no_pair():
    choose = np.random.default_rng(1)
    base = choose.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for size in choose.integers(20, 300, 150):
        own = np.unique(np.concatenate([base[:size], choose.integers(0, 2**63, choose.integers(0, 60), dtype=np.uint64)]))
        sets.append(own)
    sizes = np.array([len(s) for s in sets])
    for bits in (128, 1024):
        maps = np.stack([signature_tree.bitmap(s, bits) for s in sets])
        first, second = signature_tree.SignatureTree(maps[:90], sizes[:90]), signature_tree.SignatureTree(maps[90:], sizes[90:])
        x, y = signature_tree.candidate_pairs(first, second)
        across = set(zip(x.tolist(), (y + 90).tolist(), strict=True))
        x, y = signature_tree.candidate_pairs(first, first)
        inside = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
        for a, b in combinations(range(150), 2):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                assert (a, b) in (inside if b < 90 else across) or a >= 90
    assert len(across) < 90 * 60


def test_prefixes_meet_in_any_order():
    choose = np.random.default_rng(3)
    for _ in range(300):
        size = int(choose.integers(1, 60))
        a = choose.choice(500, size, replace=False).astype(np.uint64)
        b = np.unique(np.append(a[: size - int(choose.integers(0, 1 + size // 9))], choose.integers(500, 600, int(choose.integers(0, 1 + size // 9))).astype(np.uint64)))
        a = np.sort(a)
        if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)) or not len(b):
            continue
        common = np.unique(choose.choice(500, int(choose.integers(0, 400)))).astype(np.uint64)
        assert len(np.intersect1d(signature_tree.prefix(a, common), signature_tree.prefix(b, common)))


def test_common_passages_come_last(spark):
    choose = random.Random(5)
    shared = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{choose.randrange(10**6)}" for _ in range(60)) + " " + shared) for i in range(400)]
    rows += [(400 + i, text + " more") for i, (_, text) in enumerate(rows[:20])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    common = signature_tree.common_hashes(frame)
    passage = signature_tree.shingle_sets([shared], signature_tree.WordHashes())[0]
    assert set(passage.tolist()) <= set(common.tolist())
    firsts = signature_tree.shingle_classes(frame).select("prefix").collect()
    assert not any(np.isin(np.array(r["prefix"], np.int64).view(np.uint64), passage).any() for r in firsts)
    assert found(frame) == expected(rows)


def test_tiles_with_the_same_members_are_one():
    names = ("h", "band", "kind", "ti", "tj", "role", "rep", "component")
    alone = [(h, 9, 0, 0, 0, 0, rep, rep) for h in (1, 2, 3) for rep in (20, 10)]
    crossed = [(h, 9, 1, h, 3, role, rep, rep) for h in (4, 5) for role, rep in ((0, 10), (1, 20))]
    other = [(6, 9, 0, 0, 0, 0, 10, 10), (6, 9, 0, 0, 0, 0, 30, 30), (7, 9, 1, 0, 0, 0, 20, 20), (7, 9, 1, 0, 0, 1, 10, 10)]
    rows = pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, zip(*alone, *crossed, *other, strict=True), strict=True)})
    made = signature_tree.named_by_members(rows).to_pylist()
    assert [r["rep"] for r in made] == rows["rep"].to_pylist()
    tiles = {tuple(r[k] for k in signature_tree.TILE_KEY): set() for r in made}
    for r in made:
        tiles[tuple(r[k] for k in signature_tree.TILE_KEY)].add((r["rep"], r["role"]))
    members = sorted((key[3] == key[4], sorted(own)) for key, own in tiles.items())
    assert members == [(False, [(10, 0), (20, 1)]), (False, [(10, 1), (20, 0)]), (True, [(10, 0), (20, 0)]), (True, [(10, 0), (30, 0)])]


def test_workers_get_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en", f"one two three four five {i % 3} six") for i in range(50)], "doc_id long, lang string, text string")
    labels = spark.range(50).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    before, seen = spark.conf.get(common.BATCH_CONF), []
    for module in (signature_tree, kneser_ney):
        stored = module.materialize
        monkeypatch.setattr(module, "materialize", lambda *a, f=stored: (seen.append(int(spark.conf.get(common.BATCH_CONF))), f(*a))[1])
    assert int(before) > common.BATCH_ROWS
    signature_tree.similar_documents(docs)
    assert spark.conf.get(common.BATCH_CONF) == before
    kneser_ney.fit(docs, labels)
    assert spark.conf.get(common.BATCH_CONF) == before
    assert len(seen) > 10 and max(seen) == common.BATCH_ROWS


def test_hashes_are_shuffled_once_and_not_kept(spark, monkeypatch):
    stored, frames, plans = signature_tree.materialize, {}, {}

    def seen(frame, name="stage"):
        plans[name] = plan(frame)
        frames[name] = stored(frame, name)
        return frames[name]

    monkeypatch.setattr(signature_tree, "materialize", seen)
    monkeypatch.setattr(signature_tree, "LIGHT_ROUNDS", 0)
    rows = cluster_rows()[::3]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)
    assert plans["shared"].count("Exchange (") == 1 and "doc_id" in frames["shared"].columns
    assert "prefix" not in frames["known"].columns
    # What only the meetings are made from is gone, the rest can be read.
    for name, frame in frames.items():
        gone = name in ("shingles", "shared", "met")
        assert not any(Path(file.removeprefix("file:")).exists() for file in frame.inputFiles()) == gone, name


def test_only_stored_tables_are_removed(spark, sf, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        session.discard(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_parities_lose_no_pair_and_are_short():
    choose = np.random.default_rng(6)
    sets, shared = [], []
    for size in choose.integers(5, 700, 200):
        base = choose.integers(0, 2**63, size, dtype=np.uint64)
        for part in (0.65, 0.85, 0.89, 0.9, 0.95, 1):
            own = base[: max(1, round(part * size))]
            sets.append(np.unique(np.concatenate([own, choose.integers(0, 2**63, size - len(own), dtype=np.uint64)])))
            shared.append(part)
    sizes, bits, odd = signature_tree._fine_start()([s.tobytes() for s in sets])
    sizes = np.array(sizes)
    # Pairs of different lengths are folded.
    x, y = np.triu_indices(len(sets), 1)
    near = y - x <= 8
    x, y = x[near], y[near]
    close = signature_tree.close_pairs(x, y, odd, sizes)
    linked = [5 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - n) for i, j in zip(x, y, strict=True)]
    assert sum(linked) > 500 and close[np.array(linked)].all()
    far = ~np.array(linked) & (sizes[x] > 100) & (np.array(shared)[x] == 0.65)
    assert far.sum() > 500 and close[far].mean() < 0.01
    large = sizes > 100
    both = np.array([len(b) + len(o) for b, o in zip(bits, odd, strict=True)])
    assert (both[large] <= 0.8 * sizes[large]).all()
