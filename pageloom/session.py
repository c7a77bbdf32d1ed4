"""Where jobs put data that has to outlive an executor, and how wide they run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
TASK_ROWS = 4_000  # of a small table that are spread to one task


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of this machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get(CHECKPOINT_CONF) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
    return context.getCheckpointDir()


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/pageloom/{name}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    For results that are used more than once: what was written survives the
    loss of executors, and expensive columns are not computed again. The folder
    can go once everything made from the rows is stored.
    """
    spark = frame.sparkSession
    folder = new_dir(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def discard(stored: DataFrame) -> None:
    """Remove what ``materialize`` wrote, when everything made from it is stored too and nothing reads it again."""
    session = stored.sparkSession
    for folder in {file.rpartition("/")[0] for file in stored.inputFiles()}:
        if "/pageloom/" not in folder:
            raise ValueError(f"{folder} was not written by materialize")
        path = session._jvm.org.apache.hadoop.fs.Path(session._jvm.java.net.URI(folder))
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(source: DataFrame, *key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Give a table read from few, small files enough tasks for per-row work: one per core, and per ``task_rows`` rows.

    A large table has more splits than the session has cores and is returned as
    it is, without a shuffle. ``key`` is unique, so the parts are equally large.
    Only for tables as read and for stream batches: asking for the splits of
    anything with a shuffle in it would run that shuffle.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    if source.rdd.getNumPartitions() >= cores:
        return source
    return source.repartition(max(cores, -(-source.count() // task_rows)), *key)


def with_computed(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column so that filters on it do not compute it again.

    The optimizer moves a filter below a projection and repeats the projected
    expression in it; it does not move one below a generator.
    """
    others = [column for column in frame.columns if column != name]
    return frame.select(*others, F.explode(F.array(value)).alias(name))
