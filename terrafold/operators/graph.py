"""Networks: edges from ordered nodes, connected components, areas that a cut strands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators.tables import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``: ``(node, root)`` for every node of an edge that isn't a loop.

    Each round points every node at the neighbour (or itself) that is first in a hashed order, follows
    the pointers once more, relabels the edges by them and keeps what still joins two different labels.
    Hashed order makes the number of rounds grow as the logarithm of the longest path whatever order
    the ids have. Every round is written to the scratch root, so a lost executor costs one round; no
    link or label reaches the driver. ``root`` is some node of the component, the same for all of it.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edge = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    left = materialize(edges.where("src <> dst").select(*edge("src", "dst")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(left.select("hi", "lo"))
        up = both.groupBy("u").agg(F.min(first("v")).alias("v")).select("u", F.least(first("u"), "v")["id"].alias("p"))
        up = materialize(up, "up")
        over = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jump = materialize(up.join(over, "p").select("u", F.col("q").alias("p")), "jump")
        lo, hi = (jump.select(F.col("u").alias(c), F.col("p").alias(f"p_{c}")) for c in ("lo", "hi"))
        new = left.join(lo, "lo").join(hi, "hi").where("p_lo <> p_hi").select(*edge("p_lo", "p_hi")).distinct()
        new = materialize(new, "edges")
        discard(up)
        discard(left)
        left = new
        rounds.append(jump)
    if not rounds:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    out = rounds[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for jump in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("p"), "root")
        out = jump.join(later, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
    return out


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every row of ``nodes(node)``: the least node of its component; isolated nodes keep their own."""
    found = components(edges)
    least = found.groupBy("root").agg(F.min("node").alias("comp"))
    found = found.join(least, "root").select("node", "comp")
    return nodes.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def sub_edges(segments: DataFrame, seg: str = "seg_id", at: str = "at", node: str = "node") -> DataFrame:
    """Consecutive pairs of a segment's nodes in the order of their position: ``(seg, u, v, a0, a1)``."""
    w = Window.partitionBy(seg).orderBy(at, node)
    pairs = segments.select(seg, F.col(node).alias("u"), F.lead(node).over(w).alias("v"), F.col(at).alias("a0"), F.lead(at).over(w).alias("a1"))
    return pairs.where("v is not null")


def sub_edges_of_arrays(segments: DataFrame, seg: str = "seg_id", connectors: str = "connectors") -> DataFrame:
    """The same for ``connectors array<struct<connector_id, at>>`` in one row: no shuffle."""
    c = F.array_sort(F.transform(connectors, lambda x: F.struct(x["at"].alias("at"), x["connector_id"].alias("id"))))
    pairs = F.arrays_zip(F.slice(c, F.lit(1), F.greatest(F.lit(0), F.size(c) - 1)).alias("a"), F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1)).alias("b"))
    return segments.select(seg, F.explode(pairs).alias("p")).select(seg, F.col("p.a.id").alias("u"), F.col("p.b.id").alias("v"), F.col("p.a.at").alias("a0"), F.col("p.b.at").alias("a1"))


def largest(labels: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: the component with most nodes, or most ``weight``; ties go to the lower label."""
    size = F.count("*") if weight is None else F.sum(weight)
    return labels.groupBy("comp").agg(size.alias("size")).orderBy(F.desc("size"), "comp").limit(1)


def stranded(nodes: DataFrame, edges: DataFrame, cut: DataFrame) -> DataFrame:
    """``(node, was_main, comp, main_now, stranded)``: nodes that lose the main component when ``cut(edge_id)`` go.

    ``edges(edge_id, src, dst)``. The main component after the cut is the largest one inside that before.
    """
    before = materialize(labelled(nodes, edges), "before")
    main = largest(before).select(F.col("comp").alias("main"))
    after = materialize(labelled(nodes, edges.join(cut, "edge_id", "left_anti")).withColumnRenamed("comp", "now"), "after")
    both = before.join(after, "node").join(F.broadcast(main), F.col("comp") == F.col("main"), "left")
    both = both.select("node", F.col("main").isNotNull().alias("was_main"), F.col("now").alias("comp"))
    top = largest(both.where("was_main")).select(F.col("comp").alias("top"))
    both = both.join(F.broadcast(top), F.col("comp") == F.col("top"), "left")
    main_now = F.col("top").isNotNull() & F.col("was_main")
    return both.select("node", "was_main", "comp", main_now.alias("main_now"), (F.col("was_main") & ~main_now).alias("stranded"))


def edge_state(edges: DataFrame, state: DataFrame, cut: DataFrame) -> DataFrame:
    """Per edge ``(edge_id, cu, cv, su, sv, mu, mv, cut)``: component, stranded and main flags of both ends."""
    side = lambda c, k: state.select(F.col("node").alias(c), F.col("comp").alias(f"c{k}"), F.col("stranded").alias(f"s{k}"), F.col("main_now").alias(f"m{k}"))
    marked = cut.select("edge_id").distinct().withColumn("is_cut", F.lit(True))
    out = edges.join(side("src", "u"), "src").join(side("dst", "v"), "dst").join(marked, "edge_id", "left")
    return out.select("edge_id", "cu", "cv", "su", "sv", "mu", "mv", F.coalesce("is_cut", F.lit(False)).alias("cut"))


def group_stats(state: DataFrame, states: DataFrame) -> DataFrame:
    """Per stranded component: cut edges at it, those that lead to the main network, its nodes, and whether one crossing alone does it."""
    cut = states.where("cut")
    ends = cut.where("su").select(F.col("cu").alias("comp"), "edge_id", F.col("mv").alias("to_main"))
    ends = ends.union(cut.where("sv").select("cv", "edge_id", "mu"))
    crossings = ends.groupBy("comp").agg(F.count_distinct("edge_id").alias("n_cross"), F.count_distinct(F.when(F.col("to_main"), F.col("edge_id"))).alias("n_to_main"))
    nodes = state.where("stranded").groupBy("comp").agg(F.count("*").alias("n_nodes"))
    out = nodes.join(crossings, "comp", "left").fillna(0, ["n_cross", "n_to_main"])
    return out.select("comp", "n_cross", "n_to_main", "n_nodes", (F.col("n_cross") == 1).alias("single_crossing"))


def edge_label():
    """-2 a cut edge, the component of a stranded one, -1 on the main network, -3 anything else."""
    inside = F.col("su") & F.col("sv")
    return F.when(F.col("cut"), -2).when(inside, F.col("cu")).when(F.col("mu") & F.col("mv"), -1).otherwise(-3)
