"""Intervals, agreement, estimators, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import scoring as sc
from terrafold.operators import relational as rel
from terrafold.operators import resample
from terrafold.operators.tables import table as t
from terrafold.registry import register

_Z = "1.959963984540054::DOUBLE"
_K, _N = "COUNT(*) FILTER (quality = 1)", "COUNT(*)"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"({k})::DOUBLE / ({n})"
    return f"round(({p} + {_Z} * {_Z} / (2 * ({n})) {sign} {_Z} * sqrt({p} * (1 - {p}) / ({n}) + {_Z} * {_Z} / (4.0::DOUBLE * ({n}) * ({n})))) / (1 + {_Z} * {_Z} / ({n})), 6)"


@register("wilson", f"SELECT toxic, {_K} AS k, {_N} AS n, {_wilson_sql(_K, _N, '-')} AS low, {_wilson_sql(_K, _N, '+')} AS high FROM labels GROUP BY 1")
def wilson(spark, d):
    g = t(spark, d, "labels").groupBy("toxic").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = sc.wilson("k", "n")
    return g.select("toxic", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("kappa", "WITH r AS (SELECT quality = 1 AS a, (quality = 1 AND toxic = 0) OR doc_id % 9 = 0 AS b FROM labels), s AS (SELECT AVG((a = b)::INT) AS agree, AVG(a::INT) AS pa, AVG(b::INT) AS pb FROM r) SELECT round(agree, 6) AS agree, round(pa * pb + (1 - pa) * (1 - pb), 6) AS chance, round((agree - pa * pb - (1 - pa) * (1 - pb)) / (1 - pa * pb - (1 - pa) * (1 - pb)), 6) AS kappa FROM s")
def kappa(spark, d):
    a = F.col("quality") == 1
    b = (a & (F.col("toxic") == 0)) | (F.col("doc_id") % 9 == 0)
    s = t(spark, d, "labels").agg(F.avg((a == b).cast("int")).alias("agree"), F.avg(a.cast("int")).alias("pa"), F.avg(b.cast("int")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select(F.round("agree", 6).alias("agree"), F.round(chance, 6).alias("chance"), F.round(sc.kappa(F.col("agree"), chance), 6).alias("kappa"))


_SAMPLE = "smp AS (SELECT s_nationkey % 4 AS st, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal > 4000 END AS ok FROM supplier WHERE s_acctbal > 1000 AND s_nationkey % 4 <> 3)"


@register(
    "post_strat",
    f"""WITH {_SAMPLE}, tot AS (SELECT c_nationkey % 4 AS st, COUNT(*) AS w FROM customer GROUP BY 1), e AS (SELECT st, COUNT(ok) AS settled, COALESCE(SUM(ok::INT), 0) AS k, COUNT(*) AS n FROM smp GROUP BY 1), p AS (SELECT SUM(k)::DOUBLE / SUM(settled) AS pooled FROM e)
 SELECT round(SUM(COALESCE(k::DOUBLE / NULLIF(settled, 0), pooled) * w) / SUM(w), 6) AS estimate, round(SUM(COALESCE(k::DOUBLE / NULLIF(n, 0), 0) * w) / SUM(w), 6) AS low, round(SUM(COALESCE((k + n - settled)::DOUBLE / NULLIF(n, 0), 1) * w) / SUM(w), 6) AS high FROM tot LEFT JOIN e USING (st), p""",
)
def post_strat(spark, d):
    s = t(spark, d, "supplier").where("s_acctbal > 1000 and s_nationkey % 4 <> 3")
    s = s.select((F.col("s_nationkey") % 4).alias("st"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") > 4000).alias("ok"))
    tot = t(spark, d, "customer").groupBy((F.col("c_nationkey") % 4).alias("st")).agg(F.count("*").alias("w"))
    out = resample.post_stratified(s, tot, "st", F.col("ok"), "w")
    return out.select(*(F.round(c, 6).alias(c) for c in ("estimate", "low", "high")))


@register("ratio_estimator", "SELECT c_nationkey % 4 AS st, round(SUM(c_acctbal * (c_mktsegment = 'BUILDING')::INT) / NULLIF(SUM(c_acctbal), 0), 6) AS share FROM customer GROUP BY 1")
def ratio_estimator(spark, d):
    hit = (F.col("c_mktsegment") == "BUILDING").cast("int")
    return t(spark, d, "customer").groupBy((F.col("c_nationkey") % 4).alias("st")).agg(F.round(F.try_divide(F.sum(F.col("c_acctbal") * hit), F.sum("c_acctbal")), 6).alias("share"))


@register("standardised_rate", "WITH r AS (SELECT n_regionkey AS g, c_mktsegment AS s, COUNT(*) FILTER (c_acctbal > 5000)::DOUBLE / COUNT(*) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), w AS (SELECT c_mktsegment AS s, COUNT(*) AS w FROM customer GROUP BY 1) SELECT g, round(SUM(rate * w) / SUM(w), 6) AS rate FROM r JOIN w USING (s) GROUP BY 1")
def standardised_rate(spark, d):
    """Rates of the groups under one common mix of strata."""
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a list of nations
    r = c.groupBy(F.col("n_regionkey").alias("g"), F.col("c_mktsegment").alias("s")).agg((F.count_if(F.col("c_acctbal") > 5000) / F.count("*")).alias("rate"))
    w = c.groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("w"))
    return r.join(w, "s").groupBy("g").agg(F.round(F.sum(F.col("rate") * F.col("w")) / F.sum("w"), 6).alias("rate"))


@register("interval_verdict", "SELECT c_mktsegment AS g, CASE WHEN lo > 4700 THEN 'higher' WHEN hi < 4300 THEN 'lower' ELSE 'not distinguishable' END AS verdict FROM (SELECT c_mktsegment, AVG(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(COUNT(*)) AS lo, AVG(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(COUNT(*)) AS hi FROM customer GROUP BY 1)")
def interval_verdict(spark, d):
    half = 1.96 * F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))
    g = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg((F.avg("c_acctbal") - half).alias("lo"), (F.avg("c_acctbal") + half).alias("hi"))
    return g.select("g", sc.two_interval_verdict(F.col("lo"), F.col("hi"), F.lit(4300.0), F.lit(4700.0)).alias("verdict"))


def _users(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))


@register("bootstrap_ci")
def bootstrap_ci(spark, d):
    """Mean event value with its cluster bootstrap over users."""
    return resample.interval(resample.ratio_bootstrap(_users(spark, d), "v", "n"), above=0.0)


@register("poisson_bootstrap_ci")
def poisson_bootstrap_ci(spark, d):
    """The same under another seed: every number of units takes one way, so both intervals tell the same."""
    return resample.interval(resample.ratio_bootstrap(_users(spark, d), "v", "n", seed=1))


@register("permutation_p")
def permutation_p(spark, d):
    units = _users(spark, d).select((F.col("v") / F.col("n")).alias("v"), (F.col("user_id") % 2 == 0).alias("g"))
    return resample.permutation_p(units, "v", "g")


@register("poisson_ratio")
def poisson_ratio(spark, d):
    """Ratio of two rates with its exact interval, from one row of sums."""
    c = F.col("event_type") == "click"
    r = t(spark, d, "events").agg(F.count_if(c).alias("k1"), F.count_if(~c).alias("k2"), F.count_distinct("user_id").alias("n")).first()
    out = sc.poisson_ratio_interval(r.k1, float(r.n), r.k2, float(r.n))
    return spark.createDataFrame([tuple(float(x) for x in out)], "ratio double, low double, high double")


@register("stratified_sample", "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('20260926:' || c_custkey), c_custkey) <= 10")
def stratified_sample(spark, d):
    """Ten customers of each segment by a seeded digest."""
    return rel.sampled(t(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 10, 20260926).select("c_custkey", "c_mktsegment")
