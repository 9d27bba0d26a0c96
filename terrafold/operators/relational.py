"""Relational operators whose null, tie and order rules matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_back(areas: DataFrame, counts: DataFrame, key: str, default: float = 0) -> DataFrame:
    """Counts on the authoritative list of areas: every area once, ``default`` where it has no count."""
    return areas.join(counts, key, "left").fillna(default, [c for c in counts.columns if c != key])


def full_with_origin(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with ``origin``: both, left_only or right_only. Null keys match nothing."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    origin = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, key, "full").withColumn("origin", origin).drop("_l", "_r")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys. Keys come from the left; other columns must differ."""
    r = right.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [left[k].eqNullSafe(r[f"_{k}"]) for k in keys]
    return left.join(r, on, how).drop(*(f"_{k}" for k in keys))


def guarded_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", validate: str = "m:1") -> DataFrame:
    """Join that fails where a side that must be unique repeats a key.

    The guard is one more aggregate per unique side on the join's own key; it rides along as a
    column, so it runs within the job that uses the join.
    """
    one = {"1:1": (True, True), "one_to_one": (True, True), "m:1": (False, True), "1:m": (True, False)}[validate]

    def checked(df: DataFrame, unique: bool, side: str) -> DataFrame:
        if not unique:
            return df
        n = F.count("*").over(Window.partitionBy(key))
        guard = F.when((n > 1) & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit(f"{side} repeats {key}="), F.col(key).cast("string"))))
        return df.withColumn("_guard", guard).where(F.col("_guard").isNull()).drop("_guard")

    return checked(left, one[0], "left").join(checked(right, one[1], "right"), key, how)


def first_non_null(df: DataFrame, key: str, order: Sequence[Column | str], cols: Sequence[str]) -> DataFrame:
    """Per key and column the first value in ``order`` that isn't null: a row may mix several source rows."""
    rank = F.struct(*order)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols))


def first_row(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The whole first row per key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def combine_first(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Cells of ``one``, where null those of ``two``, on the union of the keys."""
    cols = sorted(({*one.columns} | {*two.columns}) - {key})
    a = one.select(key, *(F.col(c).alias(f"a_{c}") for c in one.columns if c != key))
    b = two.select(key, *(F.col(c).alias(f"b_{c}") for c in two.columns if c != key))
    both = a.join(b, key, "full")
    return both.select(key, *(F.coalesce(*(F.col(f"{s}_{c}") for s in "ab" if f"{s}_{c}" in both.columns)).alias(c) for c in cols))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, zero: int = 0) -> DataFrame:
    """Contingency table with every given column, zeros included; null rows and columns are left out."""
    kept = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return kept.groupBy(row).pivot(col, list(values)).count().fillna(zero)


def quartile_labels(df: DataFrame, col: str, labels: Sequence[str] = ("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """Bins of equal counts by linear quantiles, closed on the right; the least value falls in the first. Nulls stay null."""
    cuts = df.agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    c = F.col(col)
    label = F.when(c <= F.col("_q")[0], labels[0]).when(c <= F.col("_q")[1], labels[1]).when(c <= F.col("_q")[2], labels[2]).when(c.isNotNull(), labels[3])
    return df.join(F.broadcast(cuts)).withColumn("bin", label).drop("_q")  # one row


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def with_total(df: DataFrame, key: str, sums: Sequence[str], name: str = "TOTAL") -> DataFrame:
    """One row per key and a grand total, from one rollup."""
    out = df.rollup(key).agg(F.grouping(key).alias("_g"), *(F.sum(c).alias(c) for c in sums))
    return out.select(F.when(F.col("_g") == 1, name).otherwise(F.col(key)).alias(key), *sums)


def sorted_concat(col: Column | str, sep: str = "|", numeric: bool = False) -> Column:
    """Aggregate: distinct values joined in order, as numbers or as text."""
    c = F.col(col) if isinstance(col, str) else col
    values = F.array_sort(F.collect_set(c if numeric else c.cast("string")))
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep)


def weighted_mean_filled(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the weighted mean with missing values at the frame's own median."""
    median = df.agg(F.median(value).alias("_m"))
    v = F.coalesce(F.col(value), F.col("_m"))
    return df.join(F.broadcast(median)).agg(F.try_divide(F.sum(v * F.col(weight)), F.sum(weight)).alias("wavg"))  # one row


def sampled(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """Per stratum ``n`` rows by the order of a seeded digest of their key: the same rows however the table is split, here and in SQL."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows in one table only, with ``only``: left or right; repeated rows count."""
    return one.exceptAll(two).withColumn("only", F.lit("left")).union(two.exceptAll(one).withColumn("only", F.lit("right")))


def cell_differences(one: DataFrame, two: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``(key, column, left, right)`` of the cells that differ, nulls equal to nulls."""
    long = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(name)) for c in cols))).alias("z")).select(key, "z.*")
    both = long(one, "left").join(long(two, "right"), [key, "column"], "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))
