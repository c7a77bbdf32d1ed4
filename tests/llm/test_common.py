import random

import pytest

from pageloom.llm import common


def paths_and_stars():
    """A path of 3,000 ids in random order, one with the smallest ids at both ends, a star around its largest id, a loop."""
    choose = random.Random(5)
    path = list(range(10_000, 13_000))
    choose.shuffle(path)
    middle = list(range(20_002, 20_200))
    choose.shuffle(middle)
    ends = [20_000, *middle, 20_001]
    edges = [*zip(path, path[1:]), *zip(ends, ends[1:]), *[(30_500, i) for i in range(30_000, 30_500)], (40_000, 40_000)]
    choose.shuffle(edges)
    want = {**dict.fromkeys(path, 10_000), **dict.fromkeys(ends, 20_000), **dict.fromkeys(range(30_000, 30_501), 30_000), 40_000: 40_000}
    return edges, want


def test_long_paths_are_one_component(spark):
    edges, want = paths_and_stars()
    found = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(want) and {r["id"]: r["component"] for r in found} == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_bound_that_is_hit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_ROUNDS", 2)
    edges, _ = paths_and_stars()
    with pytest.raises(RuntimeError):
        common.connected_components(spark.createDataFrame(edges, "a long, b long"))
