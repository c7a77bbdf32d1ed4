"""Pages from directories of mirrored files.

The files are listed by a data source of their own (``sources/listing.py``), so the driver never
holds the tree. Paths are tested on the listing, and only the files that pass are
opened, in tasks. A file that cannot be read is a row with an error, not the end of
the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.config import ScanRules
from pageloom.functions.extract import decode_text
from pageloom.functions.paths import scan_filter
from pageloom.session import materialize
from pageloom.sources.listing import FORMAT, PARTITIONS, as_root, register

_READ = "path string, content binary, read_error string"
_TASK_BYTES = 128 * 1024 * 1024  # of files that one task reads
_MOST_BYTES = 2**31 - 2**16  # a row cannot hold more


def list_files(spark: SparkSession, directories: Iterable[str]) -> DataFrame:
    """``(path, root, inner, size)`` of every file below the directories, whatever its name.

    The tasks reach the directories with ``pyarrow.fs``.
    """
    register(spark)
    roots = sorted({as_root(directory) for directory in directories})
    # A directory inside another one would give its files twice.
    apart = [root for root in roots if not any(root.startswith(other.rstrip("/") + "/") for other in roots if other != root)]
    wanted = max(PARTITIONS, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format(FORMAT).option("directories", json.dumps(apart)).option("partitions", wanted).load()


def _write_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system = FileSystem.from_uri(row["root"])[0]
            inner = FileSystem.from_uri(row["root"])[1].rstrip("/") + "/" + row["name"]
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner, compression=None) as stream:
                stream.write(row["content"] or b"")
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["files"])


def write_files(files: DataFrame, directory: str) -> int:
    """Write ``(name, content)`` as files below a directory, in tasks; how many there are.

    A task that runs again writes the same files again.
    """
    rows = files.select(F.lit(as_root(directory)).alias("root"), "name", "content")
    return rows.mapInArrow(_write_all, "files long").agg(F.sum("files")).head()[0] or 0


def _read_file(root: str, inner: str, size: int) -> tuple[bytes | None, str | None]:
    if size > _MOST_BYTES:
        return None, f"{size} bytes are too many for a row"
    try:
        with FileSystem.from_uri(root)[0].open_input_stream(inner, compression=None) as stream:
            return stream.read(), None
    except (OSError, pa.ArrowException) as error:
        return None, str(error)


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            content, error = _read_file(row["root"], row["inner"], row["size"])
            arrays = [pa.array([row["path"]]), pa.array([content], pa.binary()), pa.array([error], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "content", "read_error"])


def scan_files(spark: SparkSession, directories: Iterable[str], rules: ScanRules) -> DataFrame:
    """``(path, raw, seq, read_error)`` of the files below the directories that pass the scan rules.

    What the rules leave out is never opened. ``raw`` is null where there is an
    error. A path occurs once, so ``seq`` is 0.
    """
    kept = list_files(spark, directories).where(scan_filter(F.col("path"), rules))
    kept = materialize(kept, "scan")
    total = kept.agg(F.sum("size")).head()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // _TASK_BYTES))
    files = kept.repartition(tasks, "path").mapInArrow(_read_all, _READ)
    return files.select(
        "path", decode_text(F.col("content")).alias("raw"), F.lit(0).cast("long").alias("seq"), "read_error"
    )
