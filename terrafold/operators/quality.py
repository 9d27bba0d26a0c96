"""Checks on inputs and results: columns, counts, file digests, recomputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def need(df: DataFrame, columns: Sequence[str], name: str, made_by: str) -> DataFrame:
    """``df`` itself, or an error that says what is missing and which step makes it."""
    if gone := missing_columns(df, columns):
        raise ValueError(f"{name} lacks {', '.join(gone)}; {made_by} writes it")
    return df


def count_checks(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """``(tbl, n, holds)`` of published row counts."""
    parts = [df.agg(F.lit(k).alias("tbl"), F.count("*").alias("n"), (F.count("*") == expected[k]).alias("holds")) for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(name, bytes, sha256)`` of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or differ in size or digest: ``(name, problem)``."""
    m = manifest.select("name", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha"))
    both = m.join(found, "name", "left")
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") != F.col("want_bytes"), "size").when(F.col("sha256") != F.col("want_sha"), "sha256")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def assert_same(one: DataFrame, two: DataFrame, what: str) -> None:
    """A recomputed table must equal the one it stands for before a variant of it counts."""
    n = one.exceptAll(two).limit(1).count() + two.exceptAll(one).limit(1).count()
    if n:
        raise AssertionError(f"{what}: the recomputed table differs")


def same_bits(one: Column, two: Column) -> Column:
    """Whether two doubles are the same number bit for bit: -0 is not 0, a NaN is itself, a null is a null.

    The decimal form of a double is one to one but for NaNs, which count as one.
    """
    return one.cast("double").cast("string").eqNullSafe(two.cast("double").cast("string"))
