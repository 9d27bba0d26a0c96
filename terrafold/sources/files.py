"""Files beside tables: what a run needs, downloads that are whole or absent, snapshots, cached answers of services."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

#: The files of a region, in the order they are read.
REGION_FILES = (
    "strata/{r}/{r}-census-tracts.parquet", "reference/{r}/{r}-sample-submission.csv", "reference/{r}/{r}-overture-roads.parquet",
    "reference/{r}/{r}-census-tiger-roads.parquet", "reference/{r}/{r}-overture-buildings.parquet", "reference/{r}/{r}-microsoft-buildings.parquet",
    "reference/{r}/{r}-overture-pois.parquet", "reference/{r}/{r}-hifld-fire-stations.csv", "reference/{r}/{r}-hifld-ems-stations.csv",
    "reference/{r}/{r}-hifld-schools.csv", "reference/{r}/{r}-census-cbp.csv",
)


def inputs(spark: SparkSession, regions: Iterable[str]) -> DataFrame:
    """``(region, n, file)``: every file that a run over the regions reads, in order."""
    rows = [(r, n, name.format(r=r)) for r in regions for n, name in enumerate(REGION_FILES)]
    return spark.createDataFrame(rows, "region string, n int, file string")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def download(spark: SparkSession, url: str, path: str, block: int = 1 << 20) -> str:
    """Fetch ``url`` into ``path`` through Spark's file systems: into a part file first, renamed when whole, so that
    ``path`` never holds half a file. An existing ``path`` is kept."""
    target, fs = _fs(spark, path)
    if fs.exists(target):
        return path
    part, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    try:
        with urllib.request.urlopen(url) as source:
            while data := source.read(block):
                out.write(bytearray(data))
        out.close()
    except BaseException:
        out.close()
        fs.delete(part, False)
        raise
    if not fs.rename(part, target):
        fs.delete(part, False)
        if not fs.exists(target):
            raise OSError(f"{path} could not be written")
    return path


def utc_stamp() -> str:
    """Now as ``YYYY-MM-DDTHH:MM:SSZ``; for names and logs, never in results."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def snapshot(spark: SparkSession, paths: Sequence[str], to: str) -> list[str]:
    """Copies of files or folders below ``to``, under their own names, through Spark's file systems."""
    out = []
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        source, fs = _fs(spark, path)
        target, into = _fs(spark, f"{to.rstrip('/')}/{source.getName()}")
        if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, into, target, False, True, conf):
            raise OSError(f"{path} could not be copied")
        out.append(target.toString())
    return out


def cached_answer(spark: SparkSession, path: str, schema: str, ask: Callable[[], list[dict]]) -> DataFrame:
    """Rows that a service answers, such as sums that it groups itself, kept as JSON lines at ``path`` and read from there next time."""
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        spark.createDataFrame([(json.dumps(r),) for r in ask()], "value string").coalesce(1).write.text(path)
    return spark.read.schema(schema).json(path)
