"""An index that follows a stream of pages.

Which id a path has, and how many versions of it there were, is kept in the state store of the stream, by
part of the paths. So a micro-batch looks up its own paths only: what was indexed
before is neither read nor grouped again. It appends what it changes:

    documents/batch_id=<n>/attempt=<a>   the new versions of documents
    vectors/batch_id=<n>/attempt=<a>     their vectors
    deletes/attempt=<a>                  (id, version) pairs that were deleted
    marks/name=<batch or delete>         written last: the attempt that counts

A batch that runs again writes a new attempt and then replaces the mark, so readers see the old attempt
or the new one and never half of any. Nothing depends on the marks of Spark's own
committers.

Version n + 1 of a document replaces version n, and a deletion removes the version it saw. The current
index is every version that nothing has replaced or deleted: an anti-join with a list that is as long
as there were changes since the last ``compact``.

New ids are unique and follow from the data and its order alone: the n-th new path of part p (of
``PARTS``, by MD5) gets ``n * PARTS + p + 1``. A deleted path that comes again goes on with its
id until the index is compacted and followed with a new checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pageloom.operators.embed import encode_batch
from pageloom.operators.index import DOCUMENT_COLUMNS, DOCUMENTS_SCHEMA, VECTORS_SCHEMA, Index
from pageloom.plans.build import BuildSettings, documents_of, extract_pages

BATCH, ATTEMPT = "batch_id", "attempt"
COMPACTED = -1  # batch of a compacted index
PARTS = 4096  # of the paths, by the first three digits of their MD5
CHANGED_SCHEMA = f"{DOCUMENTS_SCHEMA}, version long"
DELETES_SCHEMA = "id long, version long"
MARKS_SCHEMA = f"kind string, {BATCH} long, {ATTEMPT} string, name string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT_ROWS = 1000
_THINNED_ROWS = 1000  # that are turned into objects at once


def path_part(path: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(path, "UTF-8")), 1, 3), 16, 10).cast("int")


# ------------------------------------------------------------------ storage


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _marks(spark: SparkSession, directory: str) -> list:
    """One row per batch and deletion since the last compaction."""
    if not _exists(spark, f"{directory}/marks"):
        return []
    return spark.read.schema(MARKS_SCHEMA).parquet(f"{directory}/marks").collect()


def _mark(spark: SparkSession, directory: str, kind: str, batch_id: int, attempt: str) -> None:
    name = f"batch-{batch_id}" if kind == "batch" else f"{kind}-{attempt}"
    row = spark.createDataFrame([(kind, batch_id, attempt)], f"kind string, {BATCH} long, {ATTEMPT} string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{directory}/marks/name={name}")


def _valid(spark: SparkSession, directory: str, table: str, schema: str, marks: list) -> DataFrame:
    """The rows of a table that belong to a marked attempt."""
    attempts = [row[ATTEMPT] for row in marks]
    if not attempts or not _exists(spark, f"{directory}/{table}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {ATTEMPT} string").parquet(f"{directory}/{table}")
    return rows.where(F.col(ATTEMPT).isin(attempts)).drop(ATTEMPT)


def _current(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Documents and vectors of the current versions, with their version."""
    marks = _marks(spark, directory)
    documents = _valid(spark, directory, "documents", CHANGED_SCHEMA, marks)
    vectors = _valid(spark, directory, "vectors", f"{VECTORS_SCHEMA}, version long", marks)
    deleted = _valid(spark, directory, "deletes", DELETES_SCHEMA, marks)
    replaced = documents.where("version > 1").select("id", (F.col("version") - 1).alias("version"))
    gone = replaced.union(deleted)
    gone_vectors = gone.withColumnRenamed("id", "doc_id")
    return documents.join(gone, ["id", "version"], "left_anti"), vectors.join(gone_vectors, ["doc_id", "version"], "left_anti")


def current_index(spark: SparkSession, directory: str) -> Index:
    """The index as of the last complete batch, without what was deleted."""
    documents, vectors = _current(spark, directory)
    return Index(documents.select(*DOCUMENT_COLUMNS), vectors.select("doc_id", "embedding"))


def delete_where(spark: SparkSession, directory: str, gone: Column) -> int:
    """Delete the current documents that meet a condition; how many there were.

    Only the ids and versions of the deleted documents are written. Paths are tested as in
    ``operators/index.py``, for example with ``F.contains(F.col("path"), ...)``.
    """
    documents, _ = _current(spark, directory)
    return _delete(spark, directory, documents.where(F.coalesce(gone, F.lit(False))))


def delete_ids(spark: SparkSession, directory: str, ids: DataFrame) -> int:
    """Delete the current documents with one of the given ``id`` values."""
    documents, _ = _current(spark, directory)
    return _delete(spark, directory, documents.join(ids.select("id").distinct(), "id", "left_semi"))


def _delete(spark: SparkSession, directory: str, documents: DataFrame) -> int:
    attempt = uuid.uuid4().hex
    documents.select("id", "version").write.parquet(f"{directory}/deletes/{ATTEMPT}={attempt}")
    _mark(spark, directory, "delete", COMPACTED, attempt)
    return spark.read.schema(DELETES_SCHEMA).parquet(f"{directory}/deletes/{ATTEMPT}={attempt}").count()


def compact(spark: SparkSession, directory: str, target: str) -> None:
    """Write the current versions as the only batch of a new directory."""
    documents, vectors = _current(spark, directory)
    attempt = uuid.uuid4().hex
    documents.write.parquet(f"{target}/documents/{BATCH}={COMPACTED}/{ATTEMPT}={attempt}")
    vectors.write.parquet(f"{target}/vectors/{BATCH}={COMPACTED}/{ATTEMPT}={attempt}")
    _mark(spark, target, "batch", COMPACTED, attempt)


# ------------------------------------------------------------------- stream


def latest_of_batch(rows: DataFrame) -> DataFrame:
    """Of the rows of a path that stand in one stretch of an Arrow batch, the last.

    A path that makes up much of a micro-batch is thinned out before its rows meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _THINNED_ROWS) for whole in batches for at in range(0, whole.num_rows, _THINNED_ROWS)):
            last: dict[str, tuple] = {}
            columns = (batch.column(name).to_pylist() for name in ("path", "seq", "text"))
            for place, (path, seq, text) in enumerate(zip(*columns, strict=True)):
                last[path] = max(last.get(path, ((), place)), (order_of(seq, text), place))
            yield batch.take(pa.array(sorted(place for _, place in last.values()), pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def order_of(seq: int | None, text: str | None) -> tuple:
    """What decides between rows of one path: the greater ``seq``, then the greater text; null comes first."""
    return (seq is not None, seq or 0, text or "")


class Versions(StatefulProcessor):
    """Ids and versions of the paths of a part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "path string", "id long, version long")
        self.given = handle.getValueState("given", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        highest = self.given.get()[0] if self.given.exists() else 0
        for row in initialState.itertuples(index=False):
            self.known.updateValue((row.path,), (int(row.id), int(row.version)))
            highest = max(highest, (int(row.id) - 1) // PARTS + 1)
        self.given.update((highest,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}
        for chunk in rows:
            for row in chunk.to_dict("records"):
                order = order_of(None if pd.isna(row["seq"]) else int(row["seq"]), row["text"])
                if row["path"] not in last or order > last[row["path"]][0]:
                    last[row["path"]] = (order, row)
        first = given = self.given.get()[0] if self.given.exists() else 0
        made = []
        for path in sorted(last):
            found = self.known.getValue((path,))
            if found is None:
                number, version = given * PARTS + int(key[0]) + 1, 1
                given += 1
            else:
                number, version = int(found[0]), int(found[1]) + 1
            self.known.updateValue((path,), (number, version))
            row = last[path][1]
            made.append((number, path, row["url"], row["text"], row["category"], version))
            if len(made) == _OUT_ROWS:
                yield pd.DataFrame(made, columns=[*DOCUMENT_COLUMNS, "version"])
                made = []
        if given > first:
            self.given.update((given,))
        if made:
            yield pd.DataFrame(made, columns=[*DOCUMENT_COLUMNS, "version"])

    def close(self) -> None:
        pass


def new_versions(pages: DataFrame, settings: BuildSettings, initial: DataFrame | None = None) -> DataFrame:
    """``(id, path, url, text, category, version)`` of the pages of a stream.

    ``initial`` holds ``(path, id, version)`` of documents from before the stream.
    """
    documents = latest_of_batch(documents_of(extract_pages(pages, settings), settings))
    parted = documents.withColumn("part", path_part(F.col("path"))).groupBy("part")
    before = None if initial is None else initial.withColumn("part", path_part(F.col("path"))).groupBy("part")
    return parted.transformWithStateInPandas(Versions(), CHANGED_SCHEMA, "append", "none", initialState=before)


def batch_writer(directory: str, settings: BuildSettings) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends new versions with their vectors."""

    def write(changed: DataFrame, batch_id: int) -> None:
        spark, attempt = changed.sparkSession, uuid.uuid4().hex
        place = f"{BATCH}={batch_id}/{ATTEMPT}={attempt}"
        changed.write.parquet(f"{directory}/documents/{place}")
        stored = spark.read.schema(CHANGED_SCHEMA).parquet(f"{directory}/documents/{place}")
        texts = stored.select(F.col("id").alias("doc_id"), "text")
        encoded = encode_batch(texts, settings.encoder, settings.text_cap)
        versions = stored.select(F.col("id").alias("doc_id"), "version")
        encoded.join(versions, "doc_id").write.parquet(f"{directory}/vectors/{place}")
        _mark(spark, directory, "batch", batch_id, attempt)

    return write


def index_stream(
    pages: DataFrame, directory: str, checkpoint: str, settings: BuildSettings, tasks: int | None = None
) -> StreamingQuery:
    """Index everything a streaming ``(path, raw, seq)`` source has, then stop.

    ``tasks`` spreads the pages of a source with few, small files before their texts are extracted.
    A compacted directory can be followed with a new checkpoint. One that was filled by another stream cannot:
    the batches of a new checkpoint count from 0 and would take the places of the old ones.
    """
    spark = pages.sparkSession
    marks = [row for row in _marks(spark, directory) if row["kind"] == "batch"]
    if not _exists(spark, f"{checkpoint}/offsets") and any(row[BATCH] != COMPACTED for row in marks):
        raise ValueError(f"{directory} was filled with another checkpoint; go on with that one, or compact() into a new directory")
    compacted = [row for row in marks if row[BATCH] == COMPACTED]
    initial = None
    if compacted:
        initial = _valid(spark, directory, "documents", CHANGED_SCHEMA, compacted).select("path", "id", "version")
    spark.conf.set(STATE_STORE, ON_DISK)
    pages = pages.repartition(tasks) if tasks else pages
    return (
        new_versions(pages, settings, initial)
        .writeStream.foreachBatch(batch_writer(directory, settings))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
