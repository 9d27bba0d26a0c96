"""Loading tables, and writing tables between the steps of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_leaving: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder for tables between steps: ``spark.checkpoint.dir``, which every executor sees.

    Where the setting is absent a temporary folder serves, in local mode only (tests); a cluster
    without the setting is refused, since its executors don't share a machine's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="terrafold-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the application's own folder, which goes when the application ends."""
    folder = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _leaving:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _leaving.add(folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def collect_garbage(spark: SparkSession) -> None:
    """Have every executor collect its heap now: one short task a core, that calls ``System.gc`` and reads no row of any table.

    A heap grows by what is garbage already, up to its limit, and keeps that for the rest of the application; so do direct
    buffers, which go only when the heap is collected. A full collection gives both back to the system, so that a
    step has what it needs itself and not what earlier steps took. An executor whose cores are all busy is left out, and so
    is one that runs with ``-XX:+DisableExplicitGC``: that costs memory, never a row.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the scratch root and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
