"""Downloads, stamps, bits, closest points."""

import math
import re

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as geo
from terrafold.operators import quality
from terrafold.sources import files


def test_download_is_whole_or_absent(spark, tmp_path):
    source, target = tmp_path / "a.bin", tmp_path / "b.bin"
    source.write_bytes(bytes(range(256)) * 5000)
    files.download(spark, source.as_uri(), str(target), block=1000)
    assert target.read_bytes() == source.read_bytes()
    source.write_bytes(b"new")
    files.download(spark, source.as_uri(), str(target))
    assert target.stat().st_size == 256 * 5000
    with pytest.raises(OSError):
        files.download(spark, (tmp_path / "none").as_uri(), str(tmp_path / "c.bin"))
    assert not (tmp_path / "c.bin").exists() and not list(tmp_path.glob("*.part"))


def test_stamp():
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", files.utc_stamp())


def test_same_bits(spark):
    rows = [(0.1 + 0.2, 0.3), (0.5, 0.5), (0.0, -0.0), (math.nan, math.nan), (None, None), (None, 1.0), (5e-324, 5e-324)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r.s for r in df.select(quality.same_bits(F.col("a"), F.col("b")).alias("s")).collect()] == [False, True, False, True, True, False, True]


def test_closest_points(spark):
    rows = [([(0.0, 0.0), (10.0, 0.0)], [(4.0, 3.0), (4.0, 9.0)]), ([(0.0, 0.0), (10.0, 0.0)], [(5.0, -5.0), (5.0, 5.0)])]
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>")
    got = [r.c for r in df.select(geo.closest_points("p", "q").alias("c")).collect()]
    assert [(c.d, (c.p.x, c.p.y), (c.q.x, c.q.y)) for c in got] == [(3.0, (4.0, 0.0), (4.0, 3.0)), (0.0, (5.0, 0.0), (5.0, 0.0))]
