"""The registered resampling queries make the 10,000 draws of the operators' default."""

import pytest

import __spark_entry__ as entry
from terrafold.operators import resample


@pytest.mark.parametrize("name", ["bootstrap_ci", "poisson_bootstrap_ci", "two_group_bootstrap"])
def test_draws(spark, monkeypatch, name):
    monkeypatch.setattr(resample, "interval", lambda draws, above=None: draws)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == 10_000


def test_permutations(spark):
    p = entry.queries()["permutation_p"](spark, "/root/testdata/sf0.001").first().p
    assert abs(p * 10_001 - round(p * 10_001)) < 1e-6
