"""Session helpers: table loading, shared checkpoint folder, ordered chunks.

Nothing here starts a cluster.  All engine code takes an existing session and
reads its settings; only :func:`local_session` (tests, bench) builds one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "frameweave", **conf: str) -> SparkSession:
    """A single-machine session with the defaults the engine is tested with."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is used, which is only right on one
    machine; on a cluster (any master but ``local``) that is refused.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else None
    if at is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        here = tempfile.mkdtemp(prefix="frameweave-")
        atexit.register(shutil.rmtree, here, ignore_errors=True)
        at = "file://" + here
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


_written: list[str] = []  # what this process put into the shared folder beside checkpoints


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; :func:`clean_scratch` deletes what lies there."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(at)
    return at


def file_system(spark: SparkSession, path: str):
    """The path and its file system, as the cluster is set up."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path by which Python on all machines opens a file of the shared folder, None where it isn't a mounted one.

    The cluster's own file system decides what a path without a scheme means, not
    what happens to lie on the driver's disk.
    """
    at, fs = file_system(spark, path)
    return at.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote by :func:`scratch_path`; checkpoints go with their tables (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    while _written:
        at, fs = file_system(spark, _written.pop())
        fs.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_step(df: DataFrame) -> DataFrame:
    """As :func:`cut`, for what a loop joins with itself again.

    A checkpoint keeps the size estimated for its plan; joined with the next one
    the estimates multiply, and after a few dozen steps they are numbers of
    millions of digits that the planner works on for minutes.  The rows are put
    behind a plan without an estimate instead; adaptive execution goes by the
    sizes it measures.
    """
    spark, done = df.sparkSession, cut(df)
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def partitions(spark: SparkSession) -> int:
    """The number of partitions for explicit range partitioning."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def ordered_chunks(df: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``by``, with the chunk number as ``chunk``.

    A key that holds any share of the rows is spread over as many chunks as its
    rows need, because all of ``by`` takes part in the ranges.  The result is
    checkpointed: later passes see the same chunks, whatever is recomputed.
    """
    n = n or partitions(df.sparkSession)
    out = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("chunk", F.spark_partition_id())
    return cut(out)


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the data: by sorting, which spills, never by a broadcast.

    Left to itself Spark would broadcast a side whose estimated or compressed size
    is small, though its rows may fill the driver.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def few_or_merged(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A side that should be a short list, hinted for its join: to every task if its rows are counted and at most ``most``, else by sorting."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")
