"""Shared-storage helpers: lineage cuts that survive lost executors, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table whose rows are known by number is written by one task a core, or by one for so many rows if these are more.
ROWS_A_TASK = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and all tasks run in this process, a temporary folder is set; on a cluster it must be named, as a folder
    of one machine would lose what the others write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftwell-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the application's own part of it."""
    return f"{shared_dir(spark)}/driftwell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder. Results not yet read are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/driftwell/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in as many tasks as they and the cores need, not in one for each shuffle partition.

    A task that writes costs a file, and on a local file system several forks of the executor's JVM.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts lineage like ``checkpoint()`` and, being a table of its own, is columnar, compressed and readable by every
    executor, also after the one that wrote a part is gone. ``rows``: see ``in_few_tasks``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None:
        df = in_few_tasks(df, rows)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/driftwell/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``max_rows`` rows; beyond that the join shuffles and AQE splits skew."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
