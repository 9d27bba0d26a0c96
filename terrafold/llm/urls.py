"""URL filters: rules, then a path-template tree per host. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ANY, TAIL = "*", "**"


@dataclass(frozen=True)
class Tree:
    """Parameters of the template tree."""

    depth: int = 6  # segments with a node of their own; what follows is one segment, TAIL
    kids: int = 8  # from so many different segments on, a node's ordinary children are values of a variable
    heavy: float = 4.0  # a child with this many times the mean of its siblings stays itself
    z: float = 1.96  # siblings whose labelled share lies within z standard errors of the node's are alike
    prior: float = 4.0  # labels that the prior counts as
    purity: float = 0.8  # smoothed share of bad labels from which on a template is rejected


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    name = verdict = None
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return name, verdict


def shapes(path: Column) -> Column:
    """Segments of a path with plain values generalised: numbers, long hex and dates are variables wherever they stand."""
    value = lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-f]{8,}(-[0-9a-f]{4,})*", "{x}"), r"[0-9]+", "{n}")
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), value)


def template_tree(paths: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``(host, segs, template)`` of ``paths(host, segs, n, labelled, bad)``, level by level.

    Counts are summed up per (host, prefix, segment), then per (host, prefix): a host with a third
    of all pages sends each task's sums, not its pages. Each level is written out.
    """
    level = paths.withColumn("template", F.lit(""))
    held = None
    for d in range(tree.depth + 1):
        seg = F.get("segs", F.lit(d))
        if d == tree.depth:
            seg = F.when(F.size("segs") > d, TAIL)
        level = level.withColumn("seg", seg)
        if d and not level.where("seg is not null").limit(1).count():
            break
        child = level.where("seg is not null").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        child = materialize(child, "children")
        node = child.groupBy("host", "template").agg(F.count("*").alias("kids"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")))
        both = child.join(node, ["host", "template"])
        variable = (F.col("kids") >= tree.kids) & (F.col("n") * F.col("kids") <= tree.heavy * F.col("all_n"))
        share = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
        error = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
        alike = (F.col("kids") > 1) & (F.col("labelled") > 0) & (F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - share) <= tree.z * error)
        named = both.select("host", "template", "seg", F.when(variable | alike, ANY).otherwise(F.col("seg")).alias("to"))
        level = level.join(named, ["host", "template", "seg"], "left")
        level = level.select("host", "segs", "n", "labelled", "bad", F.when(F.col("to").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "to")).alias("template"))
        level = materialize(level, "level")
        discard(child)
        if held is not None:
            discard(held)
        held = level
    return level.drop("seg")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None, tree: Tree = Tree()) -> DataFrame:
    """``(id_col, host, path, rule, verdict, template, purity)`` per page.

    A rule decides where one fits. For the rest each host's paths grow a tree: variable segments become
    wildcards, branches with statistically equal shares of bad labels are merged, and a template is rejected where its
    share of bad labels, smoothed towards the whole table's (one half at most), reaches ``tree.purity``.
    Labels are the rules' own verdicts and, where given, ``labels(id_col, bad)``, which go before them.

    Pages are reduced to (host, shape of path) before anything moves; the verdicts come back by a
    join on that key, whose hot keys Spark splits. Cases: null urls and such without ``://`` have empty host and
    path and share one template; repeated rows each get a row; null ids stay; of a page's several labels the worst counts; an empty table gives an
    empty result; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    plain = plain.select("*", rule.alias("rule"), said.alias("said"), shapes(F.col("path")).alias("segs"))
    bad = F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)
    if labels is not None:
        own = labels.select(F.col(id_col).alias("id"), F.col("bad").cast("int").alias("own")).groupBy("id").agg(F.max("own").alias("own"))
        plain = plain.join(own, "id", "left")
        bad = F.coalesce("own", bad)
    counted = plain.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    grown = template_tree(materialize(counted, "paths"), tree)
    every = grown.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = min(0.5, (every[0] or 0) / every[1]) if every[1] else 0.0
    sums = grown.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + tree.prior * prior) / (F.col("labelled") + tree.prior)
    scored = sums.select("host", "template", purity.alias("purity"))
    known = materialize(grown.select("host", "segs", "template").join(scored, ["host", "template"]), "templates")
    out = plain.join(known, ["host", "segs"], "left")
    judged = F.when(F.col("purity") >= tree.purity, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "template", "purity")
