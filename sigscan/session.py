"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Estimates from here on are guesses: plans without statistics report the largest number, joins of them products.
_UNKNOWN = 1 << 50
#: What a batch of rows that Python gets may hold; Spark's own bound is in rows, which long texts make too large for a worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local master may run without the setting; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(sc, "_sigscan_root", None):
        sc._sigscan_root = "file://" + tempfile.mkdtemp(prefix="sigscan-")
        sc.setCheckpointDir(sc._sigscan_root)
    return sc._sigscan_root


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark takes it for."""
    p, fs = _hadoop_path(spark, path)
    return fs.makeQualified(p).toString()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_root(spark)}/sigscan/{name}-{uuid.uuid4().hex}"
    p, fs = _hadoop_path(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sigscan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote and nothing reads any more."""
    if getattr(df, "_sigscan_path", None):
        remove(df.sparkSession, df._sigscan_path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; for a scan the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target_bytes: int) -> int:
    """Number of partitions that hold about ``target_bytes`` of input each; the session's number where Catalyst has no estimate."""
    spark = df.sparkSession
    size = plan_bytes(df)
    if size >= _UNKNOWN:
        return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return int(max(spark.sparkContext.defaultParallelism, min(200_000, -(-size // target_bytes))))


def spread(df: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """Deal the rows of a small input over all cores, for work that costs more than moving them; a large input's scan has tasks enough."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, plan_bytes(df)
    return df.repartition(cores) if size < partition_bytes * cores else df


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python stages can import it there; bound the batches that they get, unless the session does."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_sigscan_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="sigscan-ship-")
    archive = os.path.join(folder, f"sigscan_pkg_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
    sc.addPyFile(archive)
    sc._sigscan_shipped = archive
