"""Bootstrap, permutation and stratified estimates over pre-aggregated units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of one part, about, and parts times blocks of draws at least, so that few units still make several tasks.
PART_UNITS = 100_000
LEAST_TASKS = 16


def _parts(units: DataFrame) -> tuple[DataFrame, list[int]]:
    """The units dealt into parts by a hash of their row, and the size of each part: one number a part for the driver."""
    n = units.count()
    parts = max(1, -(-n // PART_UNITS))
    dealt = units.withColumn("part", F.pmod(F.xxhash64(*units.columns), F.lit(parts)).cast("int"))
    sizes = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}
    return dealt, [sizes.get(k, 0) for k in range(parts)]


def _by_part(dealt: DataFrame, parts: int, draws: int) -> DataFrame:
    """Each part beside each block of draws ``first <= draw < last``; the blocks change the tasks only, never a draw."""
    blocks = -(-LEAST_TASKS // parts)
    each = -(-draws // blocks)
    starts = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(min(draws, a + each)).alias("last")) for a in range(0, draws, each)))
    return dealt.select("*", F.inline(starts)).groupBy("part", "first")


def ratio_bootstrap(units: DataFrame, num: str, den: str, draws: int = 10_000, seed: int = 20260926, most_units: int | None = None) -> DataFrame:
    """``(draw, value)``: ratio of sums over units drawn with replacement, as many as there are; null where the divisor is 0.

    ``units`` has one row per cluster, pre-aggregated. They are dealt into parts by a hash of their row. Every draw first
    deals its number over the parts (multinomial, the same in each task, from the draw's own seed), then each part draws that many of its
    own units and sends one pair of sums: together one draw with replacement from all units. No unit reaches the driver, nothing is
    broadcast, and every number of units takes this way. Units of equal values are exchangeable, so no key is needed.
    A null counts as 0. ``most_units`` is accepted for earlier callers and has no effect.
    """
    data = units.select(F.coalesce(F.col(num).cast("double"), F.lit(0.0)).alias("a"), F.coalesce(F.col(den).cast("double"), F.lit(0.0)).alias("b"))
    dealt, sizes = _parts(data)
    share = np.array(sizes) / max(1, sum(sizes))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[["a", "b"]].sort_values(["a", "b"]).to_numpy()
        part, first, last = (int(rows[c].iloc[0]) for c in ("part", "first", "last"))
        out = np.empty((last - first, 2))
        for k, draw in enumerate(range(first, last)):
            number = np.random.default_rng([seed, draw]).multinomial(sum(sizes), share)[part]
            out[k] = own[np.random.default_rng([seed, draw, part]).integers(0, len(own), number)].sum(0)
        return pd.DataFrame({"draw": np.arange(first, last), "a": out[:, 0], "b": out[:, 1]})

    drawn = _by_part(dealt, len(sizes), draws).applyInPandas(run, "draw int, a double, b double")
    sums = drawn.groupBy("draw").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    every = units.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    return every.join(sums, "draw", "left").select("draw", F.try_divide("a", "b").alias("value"))


def stratified_bootstrap(units: DataFrame, stratum: str, value: str, totals: dict, draws: int = 10_000, seed: int = 20260926) -> DataFrame:
    """``(draw, value)``: the strata's means under their ``totals``, each stratum's units drawn with replacement within it."""
    out = None
    for k, (name, total) in enumerate(sorted(totals.items())):  # one term a stratum, a short list by nature
        own = units.where(F.col(stratum) == F.lit(name)).select(F.col(value).alias("v"), F.lit(1).alias("n"))
        drawn = ratio_bootstrap(own, "v", "n", draws, seed + k).select("draw", (F.col("value") * F.lit(float(total))).alias("value"))
        out = drawn if out is None else out.union(drawn)
    return out.groupBy("draw").agg(F.sum("value").alias("value"))


def interval(draws: DataFrame, above: float | None = None) -> DataFrame:
    """One row: the 2.5 and 97.5 percentiles, and the share of draws above a value."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.agg(q.alias("q"), F.avg((F.col("value") > F.lit(above if above is not None else 0.0)).cast("int")).alias("share_above"))
    return out.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "share_above")


def permutation_p(units: DataFrame, value: str, group: str, draws: int = 10_000, seed: int = 20260926) -> DataFrame:
    """One row ``(observed, p)``: one-sided, mean of the group minus the rest, p = (1 + k) / (1 + draws).

    A draw deals the group's size over the parts of the units (multivariate hypergeometric, the same in each task), and each
    part picks so many of its own without replacement: together one relabelling of all units. Only sums move. Units without a value
    are left out; nulls where either side is empty.
    """
    data = units.select(F.col(value).cast("double").alias("v"), F.coalesce(F.col(group).cast("boolean"), F.lit(False)).alias("g")).where("v is not null")
    dealt, sizes = _parts(data)
    total = data.agg(F.count("*").alias("n"), F.count_if("g").alias("k"), F.sum("v").alias("v"), F.sum(F.when(F.col("g"), F.col("v"))).alias("g")).first()
    n, k = total["n"], total["k"]
    if not 0 < k < n:
        return units.sparkSession.createDataFrame([(None, None)], "observed double, p double")
    observed = total["g"] / k - (total["v"] - total["g"]) / (n - k)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows["v"].to_numpy())
        part, first, last = (int(rows[c].iloc[0]) for c in ("part", "first", "last"))
        sums = np.empty(last - first)
        for i, draw in enumerate(range(first, last)):
            number = np.random.default_rng([seed, draw]).multivariate_hypergeometric(sizes, k, method="marginals")[part]
            sums[i] = np.random.default_rng([seed, draw, part]).permutation(own)[:number].sum()
        return pd.DataFrame({"draw": np.arange(first, last), "g": sums})

    drawn = _by_part(dealt, len(sizes), draws).applyInPandas(run, "draw int, g double").groupBy("draw").agg(F.sum("g").alias("g"))
    mean = F.col("g") / k - (F.lit(total["v"]) - F.col("g")) / (n - k)
    as_much = mean >= observed - 1e-12 * (1 + abs(observed))
    return drawn.agg(F.lit(observed).alias("observed"), ((1 + F.count_if(as_much)) / F.lit(1 + draws)).alias("p"))


def post_stratified(sample: DataFrame, totals: DataFrame, stratum: str, success: Column, weight: str) -> DataFrame:
    """One row ``(estimate, low, high)``: shares of the strata under their totals; a stratum without
    settled rows takes the pooled share, and the bounds count its unsettled rows as failures, then successes."""
    each = sample.groupBy(stratum).agg(
        F.count(success).alias("settled"), F.coalesce(F.sum(success.cast("int")), F.lit(0)).alias("k"), F.count("*").alias("n")
    )
    pooled = each.agg(F.try_divide(F.sum("k"), F.sum("settled")).alias("pooled"))
    both = totals.join(each, stratum, "left").fillna(0, ["settled", "k", "n"]).join(F.broadcast(pooled))  # one row
    share = F.coalesce(F.try_divide("k", "settled"), F.col("pooled"))
    w = F.col(weight)
    low, high = F.coalesce(F.try_divide("k", "n"), F.lit(0.0)), F.coalesce(F.try_divide(F.col("k") + F.col("n") - F.col("settled"), F.col("n")), F.lit(1.0))
    mean = lambda c: F.try_divide(F.sum(c * w), F.sum(w))
    return both.agg(mean(share).alias("estimate"), mean(low).alias("low"), mean(high).alias("high"))
