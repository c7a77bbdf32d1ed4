"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pageloom.session import materialize


SLICE = 1000  # rows that a Python worker holds as objects
BATCH_ROWS = 500  # that an executor hands to a Python worker at once, where rows are wide
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ROUNDS = 150  # of connected components; twice the bits of an id are enough
_HELD: dict = {}  # of a worker: what one owner keeps from task to task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def give_back() -> None:
    """Free memory between what is still used goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def hold(owner: str, key=None, make: Callable | None = None):
    """What ``make()`` gave for this key before, kept by the worker until something with another owner is held.

    Workers outlive the queries they run. Without this a tokenizer with its memo would stay beside the model
    of another step. Without ``make``, the worker only lets go of what others left.
    """
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        give_back()
        _HELD[owner] = {}
    own = _HELD[owner]
    if make is not None and key not in own:
        own[key] = make()
    return own.get(key)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that run inside hand Python workers at most so many rows at once; a smaller setting of the session stays.

    Executors build every batch outside the heap, and twice while it grows: 10,000 texts or bitmaps of some
    kilobytes take a hundred megabytes for each running task, and not all comes back.
    """
    before = spark.conf.get(BATCH_CONF)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def drop_shuffles(frame: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    They go when the driver collects the objects of those jobs, which it has no
    need to do while the executors' disks fill up.
    """
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a table of one row per key that is first written to the shared folder.

    Both sides are then plain scans, each with an exchange of its own, so adaptive
    execution can split a key that holds a third of the left rows. The other
    way round, a join on top of the aggregation that made the right side
    would reuse its partitioning, and a hot key would stay in one task.
    """
    return left.join(materialize(right, "lookup"), on, how)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` for every id in ``(a, b)``: the smallest id it can reach.

    Every id hooks to its smallest neighbour if that is smaller, the trees made like that are
    flattened by jumps, and the edges are contracted to pairs of roots, until none is
    left. A root that nobody hooked to has a smaller neighbour in the next round; so two
    rounds leave at most half of the ids that still have edges. Every step is written to the
    shared folder; nothing is collected but whether anything is left to do.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = materialize(edges.select(*pair).distinct(), f"{name}-edges")
    labels = None
    for turn in range(MOST_ROUNDS):
        ends = left.select(F.col("b").alias("id"), "a").union(left.select(F.col("a").alias("id"), "a"))
        trees = materialize(ends.groupBy("id").agg(F.min("a").alias("component")), f"{name}-{turn}")
        for jump in range(MOST_ROUNDS):
            target = trees.select(F.col("id").alias("component"), F.col("component").alias("jump"))
            trees = materialize(
                trees.select("id", "component").join(target, "component").select(
                    "id", F.col("component").alias("old"), F.col("jump").alias("component")
                ),
                f"{name}-{turn}-{jump}",
            )
            if trees.where(F.col("old") != F.col("component")).isEmpty():
                break
        else:
            raise RuntimeError(f"trees of {name} are not flat after {MOST_ROUNDS} jumps")
        trees = trees.select("id", "component")
        if labels is None:
            labels = trees
        else:
            higher = trees.select(F.col("id").alias("component"), F.col("component").alias("higher"))
            labels = materialize(
                labels.join(higher, "component", "left").select("id", F.coalesce("higher", "component").alias("component")),
                f"{name}-labels-{turn}",
            )
        roots = left.join(trees.select(F.col("id").alias("a"), F.col("component").alias("ra")), "a")
        roots = roots.join(trees.select(F.col("id").alias("b"), F.col("component").alias("rb")), "b").where("ra <> rb")
        left = materialize(
            roots.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-pairs-{turn}"
        )
        if left.isEmpty():
            return labels
    raise RuntimeError(f"{name} still has edges after {MOST_ROUNDS} rounds")


def slices(batch: pa.RecordBatch, most_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``SLICE`` rows, halved until they have at most ``most_bytes`` or one row."""
    if batch.num_rows > SLICE:
        for at in range(0, batch.num_rows, SLICE):
            yield from slices(batch.slice(at, SLICE), most_bytes)
    elif most_bytes is None or batch.num_rows < 2 or batch.nbytes <= most_bytes:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), most_bytes)
        yield from slices(batch.slice(half), most_bytes)


def _together(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive batches that have at least so many bytes together, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def add_columns(
    frame: DataFrame, inputs: list[str], added: str, start: Callable, slice_bytes: int | None = None, group_bytes: int = 0
) -> DataFrame:
    """The rows with more columns, computed in Arrow batches; all others pass through as they are.

    ``start()`` runs once per task and returns a function from the lists of the
    input columns to the lists of the added ones. Older columns of the added names go.
    ``slice_bytes`` bounds what is turned into objects at once, besides the number of rows; with
    ``group_bytes`` the function gets so many bytes of such slices at once.
    """
    fields = T.StructType.fromDDL(added).fields
    plain = frame.drop(*[field.name for field in fields])
    kinds = [to_arrow_type(field.dataType) for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for group in _together((part for whole in batches for part in slices(whole, slice_bytes)), group_bytes):
            values = [[x for batch in group for x in batch.column(batch.schema.get_field_index(name)).to_pylist()] for name in inputs]
            made, at = work(*values), 0
            for batch in group:
                new = [pa.array(value[at : at + batch.num_rows], kind) for value, kind in zip(made, kinds, strict=True)]
                at += batch.num_rows
                names = [*batch.schema.names, *[field.name for field in fields]]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)
        give_back()

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *fields]))
