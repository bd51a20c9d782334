"""Session helpers shared by every job: reading tables, spreading scans, cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan or a union of scans, in at least as many partitions as the cluster has task slots.

    A table that lies in one small file is read by one task; Python work on it would keep one core busy.
    A scan that already has enough partitions is returned unchanged, without a shuffle. Of a frame with a shuffle the number of
    partitions is not asked, for that would run it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if "Exchange" in plan or "Aggregate" in plan or "Join" in plan:
        return df.repartition(slots)
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``; only in local mode one of our own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        named = getattr(context, "_vitsord_folder", None) or tempfile.mkdtemp(prefix="vitsord-shared-")
        context._vitsord_folder = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: later stages survive the loss of an executor.

    The table goes when the session's Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vitsord-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone; its folder goes with the cluster's
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters whose Python workers cannot import it from a shared path."""
    context = spark.sparkContext
    if getattr(context, "_vitsord_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="vitsord-")) / "vitsord_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._vitsord_shipped = True
