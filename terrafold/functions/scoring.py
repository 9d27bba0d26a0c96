"""Coverage-gap scores and statistics as Column builders. "Undefined" is null throughout."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gap(observed: Column | str, reference: Column | str, cap: bool = True) -> Column:
    """``1 - min(1, observed / reference)``; null where the reference isn't positive. Without ``cap`` the ratio may exceed 1."""
    o, r = as_col(observed), as_col(reference)
    ratio = o / r
    return F.when((r > 0) & o.isNotNull(), 1 - (F.least(F.lit(1.0), ratio) if cap else ratio))  # least() skips nulls


def mean_defined(*cols: Column | str) -> Column:
    """Mean of the values that are defined; undefined ones leave the divisor. Null if none is.

    One fold that names each value once: nested means of gaps stay small expressions.
    """
    return _mean(F.array(*map(as_col, cols)))


def _mean(values: Column) -> Column:
    """Mean of an array's values that are defined."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (acc["n"] + F.when(x.isNull(), 0).otherwise(1)).alias("n"))
    return F.aggregate(values, start, add, lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))


def round_even(c: Column | str, places: int = 6) -> Column:
    """Half to even, as arrays are rounded."""
    return F.rint(as_col(c) * 10.0**places) / 10.0**places


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


CATS = ("fire", "ems", "school")


@dataclass(frozen=True)
class Gap:
    """The gap of two counts, SQL expressions each; ``undefined`` stands for it where the reference isn't positive."""

    observed: str
    reference: str
    undefined: float | None = None


#: A gap, or the mean of those of its members that are defined.
Part = Gap | tuple["Part", ...]


def facilities(suffix: str = "", undefined: float | None = None, kinds: Sequence[str] = CATS) -> tuple[Gap, ...]:
    return tuple(Gap(f"ovt_{k}{suffix}", f"ref_{k}", undefined) for k in kinds)


ROADS, BUILDINGS, PLACES = Gap("ovt_road", "tig_road"), Gap("ovt_bldg", "ms_bldg"), Gap("ovt_places", "cbp_estab")


@dataclass(frozen=True)
class Convention:
    """A composite as data: what its parts are means of, and how they are brought together. An undefined composite is 0."""

    parts: tuple[Part, ...] = (ROADS, BUILDINGS, (facilities(), PLACES))
    divisor: float | None = None  # of the parts' sum, undefined ones 0; without it the parts' mean
    capped: bool = True
    decimals: int | None = 6
    rounded_parts: bool = False

    def like(self, part: int, new: Part) -> Convention:
        """The same with another part."""
        return replace(self, parts=(*self.parts[:part], new, *self.parts[part + 1 :]))


def _groups(part: Part) -> list[list[Gap]]:
    """A part as a mean of means of gaps."""
    return [[x] if isinstance(x, Gap) else list(x) for x in ([part] if isinstance(part, Gap) else part)]


def composites(conventions: Sequence[Convention]) -> Column:
    """One array with the composite under each convention, from one expression however many there are.

    Each gap is computed once, into an array; a convention is a row of constants that says which of them its parts are
    means of, and one lambda folds them. So the plan of a sweep of many variants is about that of one.
    """
    gaps: dict[tuple[Gap, bool], int] = {}
    spec = []
    for c in conventions:
        own = [[[gaps.setdefault((g, c.capped), len(gaps)) for g in group] for group in _groups(part)] for part in c.parts]
        lit = F.array(*(F.array(*(F.array(*map(F.lit, group)) for group in part)) for part in own))
        spec.append(F.struct(lit.alias("parts"), F.lit(c.divisor).cast("double").alias("divisor"), F.lit(c.capped).alias("capped"), F.lit(c.decimals).cast("int").alias("decimals"), F.lit(c.rounded_parts).alias("rounded")))
    filled = lambda g, capped: gap(F.expr(g.observed), F.expr(g.reference), capped) if g.undefined is None else F.coalesce(gap(F.expr(g.observed), F.expr(g.reference), capped), F.lit(g.undefined))
    values = F.array(*(filled(g, capped) for g, capped in gaps))
    rounded = lambda x, places: F.rint(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)

    def one(v: Column, c: Column) -> Column:
        each = F.transform(c["parts"], lambda part: _mean(F.transform(part, lambda group: _mean(F.transform(group, lambda i: F.get(v, i))))))
        each = F.transform(each, lambda x: F.when(c["rounded"], rounded(x, F.lit(6))).otherwise(x))
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        whole = F.coalesce(F.when(c["divisor"].isNull(), _mean(each)).otherwise(total / c["divisor"]), F.lit(0.0))
        whole = F.when(c["capped"], clip(whole)).otherwise(whole)
        return F.when(c["decimals"].isNull(), whole).otherwise(rounded(whole, c["decimals"]))

    # the values enter the lambda as an element, so that they are computed once a row
    return F.flatten(F.transform(F.array(values), lambda v: F.transform(F.array(*spec), lambda c: one(v, c))))


def composite(convention: Convention = Convention()) -> Column:
    return F.get(composites([convention]), F.lit(0))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: over rows where the value is defined."""
    v, w = as_col(value), as_col(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of ``k`` successes in ``n``; nulls where ``n`` is 0."""
    k, n = as_col(k).cast("double"), as_col(n).cast("double")
    p = F.try_divide(k, n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    return (centre - half) / scale, (centre + half) / scale


def kappa(agree: Column, chance: Column) -> Column:
    return F.try_divide(agree - chance, 1 - chance)


def two_interval_verdict(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    return F.when(low > other_high, "higher").when(high < other_low, "lower").otherwise("not distinguishable")


# --- closed forms that Spark has no function for; small, on the driver ---------------------------------------------


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or 1e-300)
            c = (1 + term / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def poisson_ratio_interval(k1: int, t1: float, k2: int, t2: float, level: float = 0.95) -> tuple[float, float, float]:
    """Rate ratio ``(k1/t1)/(k2/t2)`` with its exact interval, conditional on ``k1 + k2``."""
    tail = (1 - level) / 2
    low = beta_quantile(tail, k1, k2 + 1) if k1 else 0.0
    high = beta_quantile(1 - tail, k1 + 1, k2) if k2 else 1.0
    scale = t2 / t1
    return (k1 / t1) / (k2 / t2) if k2 else math.inf, scale * low / (1 - low), scale * high / (1 - high) if high < 1 else math.inf


def standardised(rates: Sequence[float], weights: Sequence[float]) -> float:
    """Direct standardisation: rates of the strata under common weights."""
    return math.fsum(r * w for r, w in zip(rates, weights)) / math.fsum(weights)
