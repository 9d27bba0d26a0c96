"""Draws that are dealt over parts against draws made at once."""

import numpy as np
import pytest

from terrafold.operators import resample


@pytest.mark.parametrize("most", [7, 100_000])
def test_bootstrap_equals_a_plain_one(spark, monkeypatch, most):
    monkeypatch.setattr(resample, "PART_UNITS", most)
    r = np.random.default_rng(3)
    a, b = r.gamma(2, 3, 60), r.integers(1, 9, 60)
    units = spark.createDataFrame([(float(x), int(y)) for x, y in zip(a, b)], "v double, n int")
    got = np.array([x.value for x in resample.ratio_bootstrap(units, "v", "n", 2000).collect()])
    picks = r.integers(0, 60, (20_000, 60))
    want = a[picks].sum(1) / b[picks].sum(1)
    assert len(got) == 2000
    assert got.mean() == pytest.approx(want.mean(), abs=4 * want.std() / 2000**0.5)
    assert got.std() == pytest.approx(want.std(), rel=0.08)
    assert np.percentile(got, [2.5, 97.5]) == pytest.approx(np.percentile(want, [2.5, 97.5]), abs=0.25 * want.std())


@pytest.mark.parametrize("most", [7, 100_000])
def test_permutations_equal_plain_ones(spark, monkeypatch, most):
    monkeypatch.setattr(resample, "PART_UNITS", most)
    r = np.random.default_rng(4)
    v, g = r.normal(size=50), np.arange(50) < 20
    v[g] += 0.4
    units = spark.createDataFrame([(float(x), bool(y)) for x, y in zip(v, g)], "v double, g boolean")
    got = resample.permutation_p(units, "v", "g", 2000).first()
    seen = v[g].mean() - v[~g].mean()
    plain = np.array([(s := r.permutation(v))[:20].mean() - s[20:].mean() for _ in range(20_000)])
    p = (1 + (plain >= seen).sum()) / 20_001
    assert got.observed == pytest.approx(seen) and got.p == pytest.approx(p, abs=4 * (p * (1 - p) / 2000) ** 0.5)


def test_odd_units(spark):
    none = spark.createDataFrame([], "v double, n double, g boolean")
    assert [x.value for x in resample.ratio_bootstrap(none, "v", "n", 5).collect()] == [None] * 5
    assert tuple(resample.permutation_p(none, "v", "g", 5).first()) == (None, None)
    one = spark.createDataFrame([(3.0, 2.0, True), (3.0, 2.0, None)], "v double, n double, g boolean")
    assert {x.value for x in resample.ratio_bootstrap(one, "v", "n", 5).collect()} == {1.5}
    assert resample.permutation_p(one, "v", "g", 5).first().p == 1
    strata = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.5)], "s string, v double")
    assert {x.value for x in resample.stratified_bootstrap(strata, "s", "v", {"a": 10, "b": 4}, 20).collect()} == {12.0}
