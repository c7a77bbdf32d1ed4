import numpy as np

from pageloom.llm import nn_descent, queries
from tests.llm import cases  # noqa: F401


def expected(rows, threshold=0.95):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
        parent[b] = a
    return sorted((rows[i][0], int(linked[i].sum()) - 1, rows[root(i)][0], root(i) == i) for i in range(len(rows)))


def found(frame):
    return sorted(map(tuple, nn_descent.near_vectors(frame).collect()))


def test_clusters_and_copies(spark):
    choose = np.random.default_rng(7)
    base = choose.standard_normal((300, 32))
    near = [base[0] + 0.03 * choose.standard_normal(32) for _ in range(150)]  # far more than a list holds
    pairs = [base[i] + 0.1 * choose.standard_normal(32) for i in range(1, 60)]
    copies = [base[100]] * 40
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near, *pairs, *copies])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == expected(rows)


def test_groups_that_touch_only_through_full_lists(spark):
    choose = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x)
    rows = []
    for _ in range(6):
        a = unit(choose.standard_normal(32))
        side = unit((b := choose.standard_normal(32)) - (b @ a) * a)
        for centre in (a, 0.948 * a + np.sqrt(1 - 0.948**2) * side):
            rows += [centre + 0.012 * choose.standard_normal(32) for _ in range(40)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    want = expected(rows)
    assert len({component for _, _, component, _ in want}) == 6
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == want


def test_a_missed_target_leads_to_an_exact_search(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "RECALL", 2.0)
    monkeypatch.setattr(nn_descent, "TRIES", 1)
    monkeypatch.setattr(nn_descent, "refine", lambda units, lists, k, rounds: lists.where("a % 7 = 0"))
    monkeypatch.setattr(nn_descent, "BLOCK", 40)
    choose = np.random.default_rng(9)
    base = choose.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *base[:40] + 0.1 * choose.standard_normal((40, 16)), *base[:20] + 0.15 * choose.standard_normal((20, 16))])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == expected(rows)


def test_hard_vectors(spark):
    ones = [1.0, 0.0]
    rows = [(1, ones), (2, [2e300, 0.0]), (2, [2e300, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, ones)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nn_descent.near_vectors(frame).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)], (None, 0, None, True)], key=str
    )
    assert nn_descent.near_vectors(frame.limit(0)).count() == 0


def test_query_keeps_every_vector(spark, sf):
    assert queries.QUERIES["op3_nn_descent"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
