"""Operator 9: exact Jaccard join of word shingles with signature trees.

A document is the set of its distinct runs of five words (lower-cased A-Z, cut at
ASCII white space; with fewer words, the whole sequence is its only run), each as
a 64-bit hash. Two documents link when they share 80 % of the union.

1. Equal sets are one class, represented by the smallest id.
2. Two sets that link share a run among the first fifth (and one) of their
   hashes, in any order that is the same for all. Hashes that many texts have come
   last (``common_hashes``), all others by their value. Classes meet under shared first
   hashes; of hashes with the same members one is enough. A meeting is split by size: a class meets its own size band and
   the next one, and bands with many members are cut into tiles.
3. In each tile a signature tree is built: its leaves are classes in order of size,
   inner nodes hold the bitwise OR of their token bitmaps and the range of their
   sizes. Two trees are traversed together; pairs of nodes whose largest possible
   overlap is below the smallest necessary one are dropped. First with bitmaps
   alone, then with parities of the bits beside them, which tells the classes that can have a
   partner at all; only those get their sets, for the exact count. Of tiles in which the same
   classes are left one is enough.
4. The first rounds use one meeting per class each. Their links give components; the
   last round looks at all meetings whose members are not all in one component yet. A tile tests a
   pair only if its classes are not connected already, so groups of copies cost
   about one test per member, and what comes out is a forest and never all pairs.

Null and empty texts and texts of white space have no runs and link with nothing.
Rows without an id get a null component. If rows share an id but not their words,
only the set with the smallest digest links for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.chunk_encoder import in_slices
from pageloom.llm.common import add_columns, connected_components, drop_shuffles, give_back, hold, skew_join, small_batches
from pageloom.session import discard, materialize

WORDS = 5
SHARE = (4, 5)  # links share at least this part of their union
LIGHT_ROUNDS = 3
TILE = 1024  # classes of a band in one tile
FAN_OUT = 16
PIECE = 256  # rows by which a worker's tiles grow
LEAF = 64  # a tile with so many members is one leaf of a tree
BROADCAST_KEYS = 10_000  # hashes, of 8 bytes each, that are sent to every executor at most
COMMON = 65_536  # hashes, of 8 bytes each, that come last in the order of prefixes
COUNTED = 8  # one document of so many is counted to find them
OFTEN = 3  # texts of one slice that have a hash, before it is counted
BAND = 1.26  # sizes of linked sets differ by at most 1.25
MEMO = 100_000
STEP_BYTES = 1 << 22  # of bitmaps that are compared at once
HELD_BYTES = 1 << 24  # of tiles that a worker holds, if one tile has no more


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], memo: WordHashes) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    if len(memo) > MEMO:
        memo.clear()
    words = [(text or "").encode().lower().split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    out = []
    for own in np.split(hashes, np.cumsum(counts)[:-1]) if len(words) else []:
        if len(own) == 0:
            out.append(own)
            continue
        width = min(WORDS, len(own))
        runs = np.full(len(own) - width + 1, width, np.uint64)
        for i in range(width):
            runs = (runs ^ own[i : i + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
        out.append(np.unique(runs))
    return out


def prefix_length(size: int) -> int:
    """So many of the first hashes of two linked sets, in an order that both follow, have one in common."""
    return size - -(-SHARE[0] * size // SHARE[1]) + 1 if size else 0


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first hashes of a sorted set: those that are not common come first."""
    n = prefix_length(len(hashes))
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        if late[:n].any():
            return np.concatenate([hashes[~late], hashes[late]])[:n]
    return hashes[:n]


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap over the lowest bits of the hashes; halves can be combined to a shorter one."""
    seen = np.zeros(bits, bool)
    seen[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").view(np.uint64)


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of the lowest bits an odd number of the hashes have; halves can be combined by XOR to a shorter one.

    Where two of them differ there is a hash that only one set has.
    """
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def bits_for(size: int, most: int = 8192) -> int:
    return min(max(128, 1 << int(size - 1).bit_length()), most)


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


class SignatureTree:
    """Levels of nodes; level 0 are the sets themselves in order of size."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((bitmaps[:, 0], sizes))
        bits, small = bitmaps[self.order], sizes[self.order]
        # Hashes beyond the first in a bit: so many more than common bits can two sets share.
        extra = small - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, small, small, extra)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            cuts = np.arange(0, len(bits), FAN_OUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, cuts),
                    np.minimum.reduceat(low, cuts),
                    np.maximum.reduceat(high, cuts),
                    np.maximum.reduceat(extra, cuts),
                )
            )


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes can hold a link, by their largest overlap and smallest union."""
    keep = np.ones(len(i), bool)
    part, whole = SHARE
    step = max(1, STEP_BYTES // max(1, a[0].shape[1] * 8))
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        shared = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1).astype(np.int64) + np.minimum(a[3][x], b[3][y])
        most = np.minimum(shared, np.minimum(a[2][x], b[2][y]))
        fits = (whole * a[2][x] >= part * b[1][y]) & (whole * b[2][y] >= part * a[1][x])
        keep[at : at + step] = fits & ((part + whole) * most >= part * (a[1][x] + b[1][y]))
    return keep


def candidate_pairs(a: SignatureTree, b: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Places in both inputs of all pairs that the bitmaps allow; within one tree each pair once."""
    same = a is b
    x = y = np.zeros(1, np.int64)
    levels = max(len(a.levels), len(b.levels))
    for level in reversed(range(levels)):
        # The lower tree waits at its root.
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        if level < levels - 1:
            x, y = _children(x, y, len(la[0]), level < len(a.levels) - 1, len(lb[0]), level < len(b.levels) - 1)
        if same:
            keep = x <= y if level else x < y
            x, y = x[keep], y[keep]
        keep = _possible(la, lb, x, y)
        x, y = x[keep], y[keep]
    return a.order[x], b.order[y]


def _children(x, y, nx, open_x, ny, open_y):
    steps = np.arange(FAN_OUT)
    if open_x:
        x = (x[:, None] * FAN_OUT + steps).ravel()
        y = np.repeat(y, FAN_OUT)
        x, y = x[x < nx], y[x < nx]
    if open_y:
        y = (y[:, None] * FAN_OUT + steps).ravel()
        x = np.repeat(x, FAN_OUT)
        x, y = x[y < ny], y[y < ny]
    return x, y


def small_pairs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each of many small runs."""
    x, y = [], []
    for m in np.unique(counts[counts > 1]):
        i, j = np.triu_indices(m, 1)
        at = starts[counts == m][:, None]
        x.append((at + i).ravel())
        y.append((at + j).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(x), np.concatenate(y)) if x else (none, none)


def tile_candidates(tiles: Tiles, bits: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the bitmaps allow, of all tiles; those with few members are one leaf."""
    widths = np.fromiter(map(len, bits), np.int64, len(bits))
    narrow = np.minimum.reduceat(widths, tiles.starts) if len(bits) else widths
    leaf = tiles.counts <= LEAF
    x, y = small_pairs(tiles.starts[leaf], tiles.counts[leaf])
    meets = tiles.alone[tiles.of[x]] | (tiles.role[x] != tiles.role[y])
    x, y = x[meets], y[meets]
    out_x, out_y = [], []
    for width in np.unique(narrow[leaf]):
        inside = np.flatnonzero(np.isin(tiles.of, np.flatnonzero(leaf & (narrow == width))))
        place = np.zeros(len(bits), np.int64)
        place[inside] = np.arange(len(inside))
        maps = _folded(bits, widths, inside, width)
        own = sizes[inside]
        level = (maps, own, own, own - np.bitwise_count(maps).sum(axis=1).astype(np.int64))
        chosen = narrow[tiles.of[x]] == width
        p, q = x[chosen], y[chosen]
        fits = _possible(level, level, place[p], place[q])
        out_x.append(p[fits])
        out_y.append(q[fits])
    for tile in np.flatnonzero(~leaf):
        rows = np.arange(tiles.starts[tile], tiles.starts[tile] + tiles.counts[tile])
        maps = _folded(bits, widths, rows, narrow[tile])
        sides = [rows, rows] if tiles.alone[tile] else [rows[tiles.role[rows] == side] for side in (0, 1)]
        if len(sides[0]) and len(sides[1]):
            first = SignatureTree(maps[sides[0] - rows[0]], sizes[sides[0]])
            second = first if tiles.alone[tile] else SignatureTree(maps[sides[1] - rows[0]], sizes[sides[1]])
            p, q = candidate_pairs(first, second)
            out_x.append(sides[0][p])
            out_y.append(sides[1][q])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_x]), np.concatenate([none, *out_y])


def _folded(bits: list[bytes], widths: np.ndarray, rows: np.ndarray, width: int, combine=np.bitwise_or) -> np.ndarray:
    """The bitmaps of the rows, all folded to ``width`` bytes."""
    out = np.zeros((len(rows), width // 8), np.uint64)
    for own in np.unique(widths[rows]):
        some = np.flatnonzero(widths[rows] == own)
        maps = np.frombuffer(b"".join(bits[i] for i in rows[some].tolist()), np.uint64).reshape(len(some), -1)
        out[some] = combine.reduce(maps.reshape(len(some), -1, width // 8), axis=1)
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, odd: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Which pairs of rows can be linked, by the fewest hashes that only one of the two sets has."""
    widths = np.fromiter(map(len, odd), np.int64, len(odd))
    narrow = np.minimum(widths[x], widths[y])
    apart = np.zeros(len(x), np.int64)
    for width in np.unique(narrow):
        pairs = np.flatnonzero(narrow == width)
        rows = np.unique(np.concatenate([x[pairs], y[pairs]]))
        maps = _folded(odd, widths, rows, width, np.bitwise_xor)
        place = np.zeros(len(odd), np.int64)
        place[rows] = np.arange(len(rows))
        step = max(1, STEP_BYTES // int(width))
        for at in range(0, len(pairs), step):
            some = pairs[at : at + step]
            apart[some] = np.bitwise_count(maps[place[x[some]]] ^ maps[place[y[some]]]).sum(axis=1)
    part, whole = SHARE
    return (whole + part) * apart <= (whole - part) * (sizes[x] + sizes[y])


class Tiles:
    """Rows sorted by tile: where each tile begins, and whose rows meet."""

    def __init__(self, rows: pa.Table):
        keys = np.column_stack([rows[name].to_numpy().astype(np.int64) for name in TILE_KEY])
        new = np.ones(rows.num_rows, bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        self.starts = np.flatnonzero(new)
        self.counts = np.diff(np.append(self.starts, rows.num_rows))
        self.of = np.cumsum(new) - 1
        self.role = rows["role"].to_numpy()
        first = keys[self.starts]
        self.alone = (first[:, 2] == 0) & (first[:, 3] == first[:, 4])  # a block with itself


def links_of(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], groups: list) -> list[tuple[int, int]]:
    """Linked pairs of rows among the candidates, as a forest: pairs are tested only if not connected yet."""
    parent: dict = {}

    def root(n):
        while (up := parent.get(n, n)) != n:
            parent[n] = parent.get(up, up)
            n = up
        return n

    links = []
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        u, v = root(groups[p]), root(groups[q])
        if u == v:
            continue
        shared = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        if SHARE[1] * shared >= SHARE[0] * (len(sets[p]) + len(sets[q]) - shared):
            links.append((p, q))
            parent[u] = v
    return links


# ------------------------------------------------------------------- Spark jobs

TILE_KEY = ["h", "band", "kind", "ti", "tj"]


def _tiles(meetings: DataFrame) -> DataFrame:
    """Rows ``(h, rep, size, ...)`` copied to the tiles of their bands.

    ``kind`` 0 are tiles of a band with itself, 1 of a band (role 0) with the next one (role 1).
    """
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(BAND))).cast("int")
    placed = meetings.withColumn("band", band)
    counts = placed.groupBy("h", "band").agg(F.count("*").alias("members"))
    counts = materialize(counts.where("members > 0"), "bands")
    blocks = counts.select("h", "band", F.ceil(F.col("members") / TILE).cast("int").alias("blocks"), "members")
    upper = blocks.select("h", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    lower = blocks.select("h", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    shape = blocks.join(upper, ["h", "band"], "left").join(lower, ["h", "band"], "left").na.fill(0, ["above", "below"])
    shape = shape.where("members > 1 or above > 0 or below > 0")
    known = skew_join(placed, shape, ["h", "band"], "inner")
    own = F.pmod(F.xxhash64("rep", "h"), F.col("blocks")).cast("int")
    tile = lambda band, kind, role, i, j: F.struct(
        band.alias("band"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), i.alias("ti"), j.alias("tj")
    )
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here = F.col("band")
    copies = F.concat(
        F.when(
            F.col("members") > 1,
            F.transform(
                upto(F.col("blocks")),
                lambda i: F.struct(
                    here.alias("band"),
                    F.lit(0).alias("kind"),
                    F.when(i < F.col("own"), 1).otherwise(0).alias("role"),
                    F.least(i, F.col("own")).alias("ti"),
                    F.greatest(i, F.col("own")).alias("tj"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<band:int,kind:int,role:int,ti:int,tj:int>>")),
        F.transform(upto(F.col("above")), lambda j: tile(here, 1, 0, F.col("own"), j)),
        F.transform(upto(F.col("below")), lambda i: tile(here - 1, 1, 1, i, F.col("own"))),
    )
    rest = [c for c in meetings.columns if c not in ("h", "band")]
    return known.withColumn("own", own).select("h", *rest, F.inline(copies))


def _whole_tiles(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches of a partition sorted by tile, dealt anew so that no tile is cut."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            held.append(piece)
            rows, size = rows + piece.num_rows, size + piece.nbytes
            if rows < least and size < HELD_BYTES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = int(Tiles(whole).starts[-1])
            if last:
                yield whole.slice(0, last)
            rest = whole.slice(last)
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of tiles that the bitmaps leave a partner in another component."""
    for rows in _whole_tiles(batches, 10_000):
        sizes = rows["size"].to_numpy().astype(np.int64)
        x, y = tile_candidates(Tiles(rows), rows["bits"].to_pylist(), sizes)
        groups = rows["component"].to_numpy()
        apart = groups[x] != groups[y]
        x, y = x[apart], y[apart]
        if "odd" in rows.column_names:
            close = close_pairs(x, y, rows["odd"].to_pylist(), sizes)
            x, y = x[close], y[close]
        keep = np.zeros(rows.num_rows, bool)
        keep[x] = keep[y] = True
        kept = rows.select([*TILE_KEY, "role", "rep", "component"]).filter(pa.array(keep))
        if kept.num_rows:
            yield from named_by_members(kept).to_batches()
    give_back()


def named_by_members(rows: pa.Table) -> pa.Table:
    """Whole tiles under keys that follow from their members, so that tiles with the same members have the same key.

    Two classes meet under each of the first hashes they share, and what the bitmaps leave of those
    tiles is mostly the same few classes. Tiles that got the same key by chance make one larger tile, in which
    every pair of each is tested.
    """
    tiles = Tiles(rows)
    # Of a block with itself all rows meet; else those of one role meet those of the other.
    crossed = ~tiles.alone
    member = rows["rep"].to_numpy().astype(np.uint64) * np.uint64(2) + (rows["role"].to_numpy() != 0)
    member[tiles.alone[tiles.of]] &= ~np.uint64(1)
    order = np.lexsort((member, tiles.of))
    cuts = np.split(member[order], np.cumsum(tiles.counts)[:-1])
    digests = np.array([xxhash.xxh64_intdigest(own.tobytes()) for own in cuts], np.uint64).view(np.int64)
    n = len(rows)
    columns = {
        "h": pa.array(digests[tiles.of]),
        "band": pa.array(np.zeros(n, np.int32)),
        "kind": pa.array(np.zeros(n, np.int32)),
        "ti": pa.array(np.zeros(n, np.int32)),
        "tj": pa.array(crossed[tiles.of].astype(np.int32)),
        "role": pa.array(np.where(crossed[tiles.of], rows["role"].to_numpy(), 0).astype(np.int32)),
        "rep": rows["rep"],
        "component": rows["component"],
    }
    return pa.table(columns)


def _by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_tiles(batches, 1_000):
        sets = [np.frombuffer(s, np.uint64) for s in rows["hashes"].to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        bits = [bitmap(s, bits_for(len(s))).tobytes() for s in sets]
        tiles = Tiles(rows)
        x, y = tile_candidates(tiles, bits, sizes)
        order = np.argsort(tiles.of[x], kind="stable")
        # Components of the rounds before are connected everywhere, so one forest serves all tiles here.
        groups = rows["component"].to_numpy()
        links = links_of(x[order], y[order], sets, groups.tolist())
        p, q = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(groups[p]), pa.array(groups[q])], names=["a", "b"])
    give_back()


def _tile_by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)


def _common_in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("shingles")
    memo = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in in_slices(texts):
            # Equal sets are one class and count once.
            sets = {s.tobytes(): s for s in shingle_sets(texts[a:b], memo)}
            hashes, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])


def common_hashes(documents: DataFrame) -> np.ndarray:
    """Hashes that many texts have, at most ``COMMON``, sorted.

    One document of ``COUNTED`` is counted. What is found only decides an order; the links
    are the same whatever it is, but a passage in many documents then makes no meetings.
    """
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(COUNTED)) == 0).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = some.mapInArrow(_common_in_slices, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(found["h"].to_numpy().astype(np.int64).view(np.uint64))


def _sets_start(bits: bool, common: np.ndarray | None = None):
    hold("shingles")
    memo = WordHashes()
    late = np.zeros(0, np.uint64) if common is None else common

    def work(texts):
        sets = [s for a, b in in_slices([t or "" for t in texts]) for s in shingle_sets(texts[a:b], memo)]
        if not bits:
            return ([s.tobytes() for s in sets],)
        digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
        prefixes = [prefix(s, late).view(np.int64).tolist() for s in sets]
        maps = [bitmap(s, bits_for(len(s))).tobytes() if len(s) else b"" for s in sets]
        return [len(s) for s in sets], digests, prefixes, maps

    return work


def _fine_start():
    def work(column):
        sets = [np.frombuffer(x, np.uint64) for x in column]
        bits = [bitmap(x, bits_for(len(x))).tobytes() for x in sets]
        return [len(x) for x in sets], bits, [parities(x, bits_for(2 * len(x), 1 << 20)).tobytes() for x in sets]

    return work


def _links(documents: DataFrame, meetings: DataFrame, reps: DataFrame, sets: DataFrame | None, name: str):
    """Linked components of the members of the meetings ``(h, rep, component)``, and the sets that were needed."""
    # Bitmaps join what is left after the split by size, so they are shuffled once with each tile.
    tiles = _tiles(meetings.join(reps.select("rep", "size"), "rep")).join(reps.select("rep", "bits"), "rep")
    schema = "h long, band int, kind int, ti int, tj int, role int, rep long, component long"
    survivors = materialize(_tile_by_tile(tiles).mapInArrow(_by_bitmaps, schema).distinct(), f"{name}-survivors")
    needed = survivors.select("rep").distinct()
    if sets is not None:
        needed = needed.join(sets.select("rep"), "rep", "left_anti")
    needed = materialize(needed, f"{name}-needed")
    texts = documents.select(F.col("doc_id").alias("rep"), "text").join(needed, "rep", "left_semi")
    # Of rows that share an id, the one that was counted; equal rows once.
    found = add_columns(texts, ["text"], "size int, digest binary, prefix array<long>, bits binary", lambda: _sets_start(True))
    found = found.select("rep", "digest", "text").join(reps.select("rep", "digest"), ["rep", "digest"], "left_semi")
    made = add_columns(found.dropDuplicates(["rep", "digest"]), ["text"], "hashes binary", lambda: _sets_start(False))
    new = materialize(made.select("rep", "hashes"), f"{name}-sets")
    sets = new if sets is None else sets.unionByName(new)
    # Parities are nearly exact and much smaller than the sets: half a byte or less for a hash of 8.
    fine = add_columns(sets, ["hashes"], "size int, bits binary, odd binary", _fine_start).drop("hashes")
    closer = _tile_by_tile(survivors.join(fine, "rep")).mapInArrow(_by_bitmaps, schema)
    full = materialize(closer.distinct(), f"{name}-closer").join(sets, "rep")
    links = _tile_by_tile(full).mapInArrow(_by_sets, "a long, b long")
    return materialize(links, f"{name}-links"), sets


def _relabelled(components: DataFrame, joined: DataFrame) -> DataFrame:
    """``(id, component)`` after components were joined; an id that is in none yet is one of its own."""
    labels = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    moved = components.join(labels, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(joined.join(components.select("id"), "id", "left_anti"))


def shingle_classes(documents: DataFrame) -> DataFrame:
    """``(doc_id, size, digest, prefix, bits)``, stored: what the join needs of each document."""
    common = common_hashes(documents)
    made = add_columns(
        documents.select("doc_id", "text"), ["text"], "size int, digest binary, prefix array<long>, bits binary",
        lambda: _sets_start(True, common),
    )
    return materialize(made.drop("text"), "shingles")


def similar_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``(doc_id, text)``."""
    # All work in Python is done when this returns; what is left are joins of stored tables.
    with small_batches(documents.sparkSession):
        return _similar_documents(documents.select("doc_id", "text"))


def _similar_documents(documents: DataFrame) -> DataFrame:
    shingles = shingle_classes(documents)
    known = materialize(shingles.drop("prefix"), "known")
    classes = materialize(
        known.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")),
        "classes",
    )
    owners = materialize(classes.groupBy("rep").agg(F.min("digest").alias("digest")), "owners")
    # Every hash is shuffled once: what nothing else has goes where it is counted. Until then copies bring theirs along.
    entries = shingles.where("doc_id is not null").select("doc_id", F.explode("prefix").alias("h"))
    entries = entries.withColumn("rows", F.count("*").over(Window.partitionBy("h"))).where("rows > 1").drop("rows")
    shared = materialize(entries, "shared")
    discard(shingles)
    drop_shuffles(documents)
    own = known.where("doc_id is not null").join(owners, "digest").select("doc_id", "rep").distinct()
    own = materialize(own, "class-of")
    met = materialize(shared.join(own, "doc_id").groupBy("h", "rep").agg(F.lit(1).alias("one")).drop("one"), "met")
    discard(shared)
    drop_shuffles(documents)
    groups = met.groupBy("h").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("s2")
    )
    # Of hashes with the same members one is enough.
    several = groups.where("members > 1").groupBy("members", "s1", "s2").agg(F.min("h").alias("h")).select("h")
    several = materialize(several, "several")
    meetings = materialize(met.join(F.broadcast(several) if several.count() <= BROADCAST_KEYS else several, "h"), "meetings")
    discard(met)
    touched = materialize(meetings.select("rep").distinct(), "touched")
    small = known.select(F.col("doc_id").alias("rep"), "digest", "size", "bits").join(owners, ["rep", "digest"], "left_semi")
    small = materialize(small.join(touched, "rep", "left_semi").dropDuplicates(["rep"]), "representatives")

    # Some rounds with one meeting per class connect nearly all; the last looks at every meeting that is still open.
    components = sets = None
    for turn in range(LIGHT_ROUNDS + 1):
        placed = meetings.withColumn("component", F.col("rep"))
        if components is not None:
            placed = meetings.join(components.withColumnRenamed("id", "rep"), "rep", "left")
            placed = placed.withColumn("component", F.coalesce("component", "rep"))
        if turn < LIGHT_ROUNDS:
            order = F.struct(F.xxhash64("h", F.lit(turn)), "h")
            placed = placed.groupBy("rep", "component").agg(F.min_by("h", order).alias("h"))
        placed = materialize(placed, "open")
        several = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        chosen = skew_join(placed, several.select("h"), ["h"], "inner").select("rep", "h", "component")
        links, sets = _links(documents, chosen, small, sets, f"round-{turn}")
        joined = connected_components(links, f"components-{turn}")
        components = joined if components is None else materialize(_relabelled(components, joined), "components")
        drop_shuffles(documents)

    final = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left")
    final = final.select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = skew_join(known.select("doc_id", "size", "digest"), final, ["digest"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without those that have a smaller id in their component; all columns, rows of one id once."""
    found = similar_documents(documents)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
