"""Sources: files by layout, GeoJSON, string CSVs with lineage, paged services, versioned listings."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Path patterns of the layouts in which a region's files may lie.
LAYOUTS = ("{root}/{region}/{name}", "{root}/{name}/{region}", "{root}/region={region}/{name}", "{root}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, root: str, region: str, name: str) -> str:
    """The first layout that exists, through Spark's own file systems."""
    for layout in LAYOUTS:
        if exists(spark, path := layout.format(root=root, region=region, name=name)):
            return path
    raise FileNotFoundError(f"{name} of {region} under {root}")


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Parquet with pruned columns; ``box`` (xmin, xmax, ymin, ymax) goes to the files as a filter on the ``bbox`` struct."""
    df = spark.read.parquet(path)
    if box:
        xmin, xmax, ymin, ymax = box
        df = df.where((F.col("bbox.xmax") >= xmin) & (F.col("bbox.xmin") <= xmax) & (F.col("bbox.ymax") >= ymin) & (F.col("bbox.ymin") <= ymax))
    return df.select(*columns) if columns else df


def scan_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet under a given schema; columns that a file lacks are null."""
    return spark.read.schema(schema).parquet(path)


def with_position(df: DataFrame) -> DataFrame:
    """File and row number as the key of rows that have none."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row") if "row_index" in _metadata(df) else F.lit(None).cast("long").alias("row"))


def _metadata(df: DataFrame) -> list[str]:
    return df.select("_metadata").schema[0].dataType.fieldNames()


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with a header under a schema; only an empty field is null."""
    reader = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(paths)


def read_csv_lineage(spark: SparkSession, paths: Sequence[str], schema: str, keep=None) -> DataFrame:
    """Many (compressed) CSVs as strings, filtered as they are read, each row with its file's name."""
    df = read_csv(spark, list(paths), schema)
    df = df.where(keep) if keep is not None else df
    return df.withColumn("source_file", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0))


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str = "type string, coordinates array<double>") -> DataFrame:
    """Point features as rows: their properties and ``_lon``, ``_lat``."""
    kind = f"type string, features array<struct<type:string, properties:struct<{_as_struct(properties)}>, geometry:struct<{_as_struct(geometry)}>>>"
    f = spark.read.option("multiLine", True).schema(kind).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("_lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("_lat"))


def _as_struct(ddl: str) -> str:
    import re

    return re.sub(r"(\w+) (?=\w)", r"\1:", ddl)


def newest_versions(listing: DataFrame) -> DataFrame:
    """The newest file of each (table, year) of ``listing(file)``, names like ``name_dYYYY_cYYYYMMDD.csv.gz``."""
    pattern = r"^(.+)_d(\d{4})_c(\d{8})"
    parts = [F.regexp_extract("file", pattern, i).alias(n) for i, n in ((1, "tbl"), (2, "year"), (3, "created"))]
    named = listing.select("file", *parts).where("tbl <> ''")
    return named.groupBy("tbl", F.col("year").cast("int").alias("year")).agg(F.max_by("file", F.struct("created", "file")).alias("file"))


class PagedSource(DataSource):
    """A service that tells its count and answers pages, as a Spark source: one partition a page.

    Options: ``fetch``, an importable ``module:function`` called as ``fetch(offset, limit) -> rows`` and ``fetch(None, None) -> count``;
    ``schema``; ``page`` (rows a page, 1000); ``retries`` (5); ``envelope`` (xmin,ymin,xmax,ymax), which the service applies: it is then
    called as ``fetch(offset, limit, envelope)``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        super().__init__(offset)
        self.offset = offset


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def _fetch(self) -> Callable:
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        return getattr(importlib.import_module(module), name)

    def _again(self, *args):
        if box := self.options.get("envelope"):
            args = (*args, tuple(map(float, box.split(","))))
        for left in range(int(self.options.get("retries", 5)) - 1, -1, -1):
            try:
                return self._fetch()(*args)
            except OSError:
                if not left:
                    raise

    def partitions(self) -> list[Page]:
        return [Page(a) for a in range(0, self._again(None, None), int(self.options.get("page", 1000)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self._again(partition.offset, int(self.options.get("page", 1000)))


_POINT = T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())


@F.pandas_udf(T.ArrayType(T.ArrayType(_POINT)))
def wkb_rings(wkb: pd.Series) -> pd.Series:
    """Well-known binary to parts: a point or a line is one part, a polygon its rings, a collection all of its parts'."""
    return wkb.map(lambda b: None if b is None else decode_wkb(bytes(b)))


def decode_wkb(data: bytes) -> list[list[dict]]:
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def shape() -> list[list[dict]]:
        end = "<" if take("B")[0] else ">"
        kind = take(end + "I")[0]
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[kind % 0x10000000 // 1000]
        if kind & 0x20000000:
            take(end + "I")
        kind = kind % 0x10000000 % 1000

        def run(n: int) -> list[dict]:
            return [dict(zip("xy", take(f"{end}{dims}d"))) for _ in range(n)]

        if kind == 1:
            return [run(1)]
        n = take(end + "I")[0]
        if kind == 2:
            return [run(n)]
        if kind == 3:
            return [run(take(end + "I")[0]) for _ in range(n)]
        return [part for _ in range(n) for part in shape()]

    return shape()
