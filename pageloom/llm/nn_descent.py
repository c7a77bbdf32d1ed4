"""Operator 3: near copies among vectors by NN-descent.

1. Vectors that are null, zero or hold null or non-finite numbers link with nothing. Equal
   vectors are one class; the others' work is done on classes.
2. The first neighbour lists come from several sorted orders of random sign codes:
   chunks of neighbours in code order are compared in blocks.
3. Each round joins the neighbours of every class with each other: whoever meets at
   a common neighbour is compared, and every list keeps its best. Rounds end when
   few lists change.
4. A list full of neighbours above the threshold is saturated; there may be more of
   them. Classes with such a list are compared with those of other components: cells of
   members whose centres and radii leave room for a link meet block by block, and
   links found join the components. The components that hold a saturated list are then compared
   within themselves, block by block, which is the list enlarged to the whole
   component; only counts and one link per class and block leave a block.
5. Audit vectors, one part of them with links, are compared with all vectors; if the graph
   has found less than ``RECALL`` of their links, the lists grow and rounds go on. After
   ``TRIES`` all blocks are compared.

Rows that share an id are kept apart as rows, and one vector for linking.
Null ids get null components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import connected_components, skew_join
from pageloom.session import materialize

THRESHOLD = 0.95
LIST = 12
ORDERS = 6
CHUNK = 256
ROUNDS = 6
SETTLED = 0.01  # rounds end when a smaller part of the lists changes
MEETING = 96  # neighbours that meet in one group; more are dealt to several
BLOCK = 1024
AUDIT = 512  # audit vectors at least, of all and of those with links: those with the smallest hashes of the id
AUDIT_ROOT = 4  # so many times the root of the number of classes, if that is more
RECALL = 0.98
TRIES = 3

UNIT = "id long, size long, v binary"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)``: the vector divided by its length, as bytes of doubles; null if it cannot link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch["embedding"]:
                x = None if value is None else np.array([np.nan if c is None else c for c in value], np.float64)
                scale = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else np.abs(x).max()
                if not scale:
                    out.append(None)
                    continue
                x = x / scale  # no overflow and no underflow of the squares
                out.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "v": out})

    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return ids.mapInPandas(run, "vec_id long, v binary")


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def _best(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of each row of a score matrix, without the row itself."""
    scores = np.where(ids[:, None] == others[None, :], -np.inf, scores)
    k = min(k, scores.shape[1])
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    found = pd.DataFrame({"a": ids[rows], "b": others[best.ravel()], "s": scores[rows, best.ravel()]})
    return found[np.isfinite(found["s"])]


def _code_orders(dims_seed: int, orders: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            lengths = np.array([len(v) for v in batch["v"]])
            for length in np.unique(lengths):  # vectors of other lengths never meet
                own = batch[lengths == length]
                x = _matrix(own["v"])
                planes = np.random.default_rng((dims_seed, x.shape[1])).standard_normal((orders, x.shape[1], 48))
                for turn in range(orders):
                    bits = (x @ planes[turn] > 0) @ (1 << np.arange(47, -1, -1, dtype=np.int64))
                    yield pd.DataFrame({"turn": turn, "dims": int(length), "code": bits, "id": own["id"], "v": own["v"]})

    return run


def _chunk_lists(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Neighbouring rows of an order, in chunks that overlap by a half."""
        held = None
        for batch in batches:
            for _, rows in batch.groupby(["turn", "dims"], sort=False):
                if held is not None and tuple(held.iloc[0][["turn", "dims"]]) == tuple(rows.iloc[0][["turn", "dims"]]):
                    rows = pd.concat([held, rows], ignore_index=True)
                for at in range(0, max(len(rows) - CHUNK // 2, 1), CHUNK // 2):
                    part = rows.iloc[at : at + CHUNK]
                    x, ids = _matrix(part["v"]), part["id"].to_numpy()
                    yield _best(ids, ids, x @ x.T, k)
                held = rows.iloc[-(CHUNK // 2) :]

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each list; equal scores by id."""
    pairs = found.groupBy("a", "b").agg(F.max("s").alias("s"))
    lists = pairs.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "b"))), 1, k).alias("l"))
    return lists.select("a", F.inline("l")).select("a", "b", (-F.col("s")).alias("s"))


def _meet(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Everyone in a meeting against everyone; old acquaintances stay away from each other."""
        ids, x, fresh = rows["id"].to_numpy(), _matrix(rows["v"]), rows["fresh"].to_numpy()
        scores = np.where(fresh[:, None] | fresh[None, :], x @ x.T, -np.inf)
        return _best(ids, ids, scores, k)

    return run


def refine(units: DataFrame, lists: DataFrame, k: int, rounds: int) -> DataFrame:
    """Rounds of neighbours of neighbours, until the lists settle."""
    lists = lists.withColumn("fresh", F.lit(True))
    n = units.count()
    for turn in range(rounds):
        # Forward and backward neighbours meet at their common neighbour.
        both = lists.select(F.col("a").alias("at"), F.col("b").alias("id"), "fresh").union(
            lists.select(F.col("b"), F.col("a"), "fresh")
        )
        both = both.groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
        degree = materialize(both.groupBy("at").agg(F.count("*").alias("n"), F.max("fresh").alias("some")), "degrees")
        placed = both.join(degree.where("some and n > 1").drop("some"), "at")
        # A hub's neighbours are dealt to several meetings, differently in every round.
        part = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("n") / MEETING))
        members = placed.select("at", part.alias("part"), "id", "fresh").join(units.select("id", "v"), "id")
        met = members.groupBy("at", "part").applyInPandas(_meet(k), "a long, b long, s double")
        old = lists.select("a", "b", "s", F.lit(1).alias("old"))
        pairs = old.drop("old").union(met)
        new = _top(pairs, k).join(old.drop("s"), ["a", "b"], "left")
        lists = materialize(new.select("a", "b", "s", F.col("old").isNull().alias("fresh")), f"lists-{turn}")
        if lists.where("fresh").count() < SETTLED * n * k:
            break
    return lists.drop("fresh")


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a block, the first row that links reach (the number of rows: none)."""
    none = len(linked)
    rows = np.arange(none)
    while True:
        columns = np.where(linked, rows[:, None], none).min(axis=0)
        new = np.minimum(rows, np.where(linked, columns[None, :], none).min(axis=1))
        if (new == rows).all():
            return rows, columns
        rows = new


def _block_links(threshold: float, spanning: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each class of one block, the rows of linked classes of the other, and one linked class.

        If ``spanning``, a class that links reach, for classes of both blocks, so that all that is linked stays together.
        """
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": [], "other": []}).astype("int64")
        ids, others, sizes = left["id"].to_numpy(), right["id"].to_numpy(), right["size"].to_numpy()
        x, y = _matrix(left["v"]), _matrix(right["v"])
        linked = (x @ y.T >= threshold) & (ids[:, None] != others[None, :])
        some = linked.any(axis=1)
        n = (linked @ sizes)[some]
        if not spanning:
            return pd.DataFrame({"id": ids[some], "n": n, "other": others[linked.argmax(axis=1)[some]]})
        first, second = _spanning(linked)
        met = second < len(ids)
        own = pd.DataFrame({"id": ids[some], "n": n, "other": ids[first[some]]})
        return pd.concat([own, pd.DataFrame({"id": others[met], "n": 0, "other": ids[second[met]]})])

    return run


def within_components(units: DataFrame, components: DataFrame, threshold: float, spanning: bool = False) -> DataFrame:
    """``(id, n, other)`` for classes linked within their component, from pairs of blocks."""
    placed = units.join(components, "id")
    counts = placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    known = skew_join(placed, counts, ["component"], "inner")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    known = known.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = known.select("component", F.col("own").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "id", "size", "v")
    right = known.select("component", F.col("block").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "size", "v")
    blocks = left.union(right).groupBy("component", "i", "j")
    return blocks.applyInPandas(_block_links(threshold, spanning), "id long, n long, other long")


def _exact_links(units: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Listed pairs at or above the threshold, both ways."""
    sure = pairs.where(F.col("s") >= threshold).select("a", "b")
    return sure.union(sure.select("b", "a")).distinct()


def _cells(rows: pd.DataFrame) -> pd.DataFrame:
    """The centre of a cell and the angle to its farthest member."""
    x = _matrix(rows["v"])
    centre = x.sum(axis=0)
    centre = centre / length if (length := np.sqrt((centre * centre).sum())) else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    return pd.DataFrame({"component": [rows["component"].iloc[0]], "cell": [rows["cell"].iloc[0]], "centre": [centre.tobytes()], "radius": [radius]})


def _near_cells(threshold: float):
    room = float(np.arccos(threshold)) + 1e-6

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Cells of different components that are near enough for a link."""
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"ca": [], "ka": [], "cb": [], "kb": []}).astype("int64")
        angle = np.arccos(np.clip(_matrix(left["centre"]) @ _matrix(right["centre"]).T, -1, 1))
        near = angle <= left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()[None, :] + room
        ca, cb = left["component"].to_numpy(), right["component"].to_numpy()
        i, j = np.nonzero(near & (ca[:, None] < cb[None, :]))
        return pd.DataFrame({"ca": ca[i], "ka": left["cell"].to_numpy()[i], "cb": cb[j], "kb": right["cell"].to_numpy()[j]})

    return run


def across_components(units: DataFrame, components: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` between classes of ``full`` in different components: for each class and cell one, if there is any."""
    placed = units.join(full, "id").join(components, "id")
    counts = placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cells"))
    known = skew_join(placed, counts, ["component"], "inner")
    cell = F.pmod(F.xxhash64("id"), F.col("cells")).cast("long")
    members = materialize(known.select("component", cell.alias("cell"), "id", "size", "v"), "saturated")
    made = members.groupBy("component", "cell").applyInPandas(_cells, "component long, cell long, centre binary, radius double")
    cells = materialize(made.withColumn("dims", F.octet_length("centre")), "cells")
    blocks = F.greatest(F.ceil(F.lit(cells.count()) / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("component", "cell"), blocks).cast("int")
    dealt = cells.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    kept = ["dims", "component", "cell", "centre", "radius"]
    left = dealt.select(F.col("own").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), *kept)
    right = dealt.select(F.col("block").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *kept)
    near = left.union(right).groupBy("dims", "i", "j").applyInPandas(_near_cells(threshold), "ca long, ka long, cb long, kb long")
    near = materialize(near, "near-cells")
    pair = ["ca", "ka", "cb", "kb"]
    sides = [
        near.join(members.withColumnsRenamed({"component": c, "cell": k}), [c, k]).select(*pair, F.lit(side).alias("side"), "id", "size", "v")
        for side, (c, k) in enumerate((("ca", "ka"), ("cb", "kb")))
    ]
    met = sides[0].union(sides[1]).groupBy(*pair).applyInPandas(_block_links(threshold, False), "id long, n long, other long")
    return met.select(F.col("id").alias("a"), F.col("other").alias("b"))


def _audit(units: DataFrame, counts: DataFrame, links: DataFrame, threshold: float) -> tuple[int, int]:
    """True and found links of the audit vectors."""
    number = max(AUDIT, math.ceil(AUDIT_ROOT * math.sqrt(units.count())))
    linked = units.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    parts = [x.orderBy(F.xxhash64("id")).limit(number).select("id", "v") for x in (units, linked)]
    chosen = parts[0].union(parts[1]).dropDuplicates(["id"]).toPandas()
    if not len(chosen):
        return 0, 0
    by_length = {n: (own["id"].to_numpy(), _matrix(own["v"])) for n, own in chosen.groupby(chosen["v"].map(len))}
    sent = units.sparkSession.sparkContext.broadcast(by_length)  # a number that grows with the root of the table's

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole[at : at + 2 * BLOCK] for whole in batches for at in range(0, len(whole), 2 * BLOCK)):
            for length, own in batch.groupby(batch["v"].map(len)):
                if length in sent.value:
                    ids, x = sent.value[length]
                    near = (x @ _matrix(own["v"]).T >= threshold) & (ids[:, None] != own["id"].to_numpy()[None, :])
                    some = near.any(axis=1)
                    yield pd.DataFrame({"id": ids[some], "true": (near @ own["size"].to_numpy())[some]})

    true = units.mapInPandas(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    found = F.least("true", F.coalesce("n", F.lit(0)))
    row = true.join(counts, "id", "left").agg(F.sum("true").alias("true"), F.sum(found).alias("found")).head()
    return row["true"] or 0, row["found"] or 0


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = LIST) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``(vec_id, embedding)``."""
    rows = materialize(unit_vectors(vectors), "unit-vectors")
    known = rows.where("v is not null and vec_id is not null")
    classes = known.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    # Rows that share an id but not the vector: the id stands for the first of them.
    units = materialize(classes.dropDuplicates(["id"]).select("id", "size", "v"), "vector-classes")
    parts = 4 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = units.select("id", "v").mapInPandas(_code_orders(11, ORDERS), "turn int, dims int, code long, id long, v binary")
    order = ["turn", "dims", "code", "id"]
    chunks = codes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    first = chunks.mapInPandas(_chunk_lists(k), "a long, b long, s double")
    lists = materialize(_top(first, k), "first-lists")
    for _ in range(TRIES):
        lists = refine(units, lists, k, ROUNDS)
        links = materialize(_exact_links(units, lists, threshold), "links")
        components = connected_components(links, "near")
        full = lists.where(F.col("s") >= threshold).groupBy("a").count().where(F.col("count") >= k)
        full = materialize(full.select(F.col("a").alias("id")), "full")
        across = materialize(across_components(units, components, full, threshold), "across")
        if not across.isEmpty():
            links = materialize(links.union(across).union(across.select("b", "a")).distinct(), "links")
            components = connected_components(links, "near")
        wide = components.join(full, "id").select("component").distinct()
        inside = materialize(
            within_components(units, skew_join(components, wide, ["component"], "inner"), threshold), "inside"
        )
        # Every link inside an enlarged component is known.
        same = skew_join(components, wide.withColumn("wide", F.lit(True)), ["component"]).where("wide")
        pairs = links.union(
            inside.select(F.col("id").alias("a"), F.col("other").alias("b"))
        ).distinct()
        counts = inside.groupBy("id").agg(F.sum("n").alias("n"))
        narrow = links.join(same.select(F.col("id").alias("a")), "a", "left_anti")
        sized = skew_join(narrow.withColumnRenamed("b", "id"), units.select("id", "size"), ["id"], "inner")
        counts = materialize(counts.union(sized.groupBy(F.col("a").alias("id")).agg(F.sum("size").alias("n"))), "counts")
        true, found = _audit(units, counts, links, threshold)
        if found >= RECALL * true:
            break
        k *= 2
    else:
        everyone = units.select("id", F.octet_length("v").cast("long").alias("component"))
        inside = materialize(within_components(units, everyone, threshold, spanning=True), "all-blocks")
        pairs = inside.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
        counts = inside.groupBy("id").agg(F.sum("n").alias("n"))
    final = connected_components(pairs, "vectors")
    out = units.join(counts, "id", "left").join(final, "id", "left")
    out = out.select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    done = skew_join(rows, out, ["v"])
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return done.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
