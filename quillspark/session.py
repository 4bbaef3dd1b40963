"""Session set-up and the shared working folder."""

from __future__ import annotations

import posixpath
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillspark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session (a test, a notebook) may do without the setting; it
    then gets a new temporary folder, remembered for the rest of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The session's own folder for intermediate tables, below the shared one."""
    return posixpath.join(shared_folder(spark), f"quillspark-{spark.sparkContext.applicationId}")


def drop_run_folder(spark: SparkSession) -> None:
    """Delete the session's intermediate tables; frames that read them cannot be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's folder."""
    return posixpath.join(run_folder(spark), f"{name}-{uuid.uuid4().hex}")


#: Spark's setting that drops the shuffle files of an execution when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping, _lock = {}, threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions that begin in here leave no shuffle files behind, for results that no one works out a second time.

    Otherwise the files stay until the driver's garbage collector meets what refers to them.  Threads may be in here side by side.
    """
    key = id(spark._jsparkSession)
    with _lock:
        inside, before = _dropping.get(key) or (0, spark.conf.get(DROP_SHUFFLES, "false"))
        _dropping[key] = inside + 1, before
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            inside, before = _dropping.pop(key)
            if inside > 1:
                _dropping[key] = inside - 1, before
            else:
                spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the optimiser
    exact sizes of the stage for what follows.  Its shuffle files go when it is written.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.stage_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables given by ``materialize`` whose last reader has been written; they cannot be read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Partitions for each core below which a scan may leave cores without rows.
SCAN_PARTITIONS = 3


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows over all cores where the scan gives few partitions for each of them.

    A table of one small file is one task, and of the ranges of a file with one
    row group only one has rows, however many are read.  A large table has
    several partitions for each core and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < SCAN_PARTITIONS * cores else df
