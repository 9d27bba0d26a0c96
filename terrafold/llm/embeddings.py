"""Embedding near-dedup: tiles compared along principal axes, with suffix norms as bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import components, materialize, spread, union_roots

#: Distinct vectors of a tile.
TILE = 2048
#: Vectors at most from which the axes are fitted; the axes change the speed only, never a result.
FIT = 8192
#: Leading axes whose ranges a tile keeps, to leave out pairs of tiles that are too far apart.
RANGES = 4
#: Rounding room of the bounds; pairs so near to the threshold are computed again from the vectors as given.
ROOM = 1e-9
#: Strips of the first axis to the radius of the threshold, by which tiles are dealt to be paired.
STRIPS = 32


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, most variance first, of unit vectors."""
    if not len(sample):
        return np.eye(sample.shape[1])
    _, vectors = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))
    return vectors[:, ::-1]


def unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that very long or short ones keep their direction."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", unit(a), unit(b))


def linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with cosine of ``threshold`` or more; ``a`` and ``b`` are unit rows along the axes.

    Products of the leading axes come first. What the others can add is at most the product of
    the suffix norms (Cauchy-Schwarz), so a pair below the threshold with that bound stops there.
    While many pairs are left the next axes are one matrix product, later only the pairs' own.
    """
    d = a.shape[1]
    cuts = sorted({min(d, c) for c in (d // 8, d // 4, d // 2, d) if c} | {d})
    found = []
    for at in range(0, len(a), 256):
        block = a[at : at + 256]
        partial, done, pairs = np.zeros((len(block), len(b))), 0, None
        for cut in cuts:
            rest = [np.linalg.norm(x[:, cut:], axis=1) for x in (block, b)]
            if pairs is None:
                partial += block[:, done:cut] @ b[:, done:cut].T
                alive = partial + np.outer(*rest) >= threshold - ROOM
                if cut == d or alive.mean() < 0.02:
                    pairs = np.nonzero(alive)
                    partial = partial[pairs]
            else:
                partial = partial + np.einsum("ij,ij->i", block[pairs[0], done:cut], b[pairs[1], done:cut])
                alive = partial + rest[0][pairs[0]] * rest[1][pairs[1]] >= threshold - ROOM
                pairs, partial = (pairs[0][alive], pairs[1][alive]), partial[alive]
            done = cut
        i, j = pairs
        near = np.flatnonzero(np.abs(partial - threshold) <= ROOM)
        keep = partial >= threshold
        if len(near):
            keep[near] = exact_cosine(raw_a[at + i[near]], raw_b[j[near]]) >= threshold
        found.append((at + i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _tiles(shared, tile: int):
    """Number the rows of a sorted partition by tiles that don't cross a group; add the leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("grp").to_pylist()
            out = []
            for g in group:
                if last is not None and (g != last or size == tile):
                    number, size = number + 1, 0
                last, size = g, size + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "tile"])

    return run


def _leading(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = shared.value
        for batch in batches:
            lead = np.zeros((batch.num_rows, RANGES))
            dims = np.array(batch.column("dim").to_pylist(), dtype=np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                rows = unit(_matrix(batch.column("vector").take(pa.array(own))))
                y = rows @ bases[int(d)][:, :RANGES]
                lead[own[:, None], np.arange(y.shape[1])] = y
            arrays = [pa.array(lead[:, k]) for k in range(RANGES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f"y{k}" for k in range(RANGES))])

    return run


def _compare(shared, threshold: float):
    """Rows ``(cls, links, root)``: links of a class in this pair of tiles (by number of vectors), or an edge of a forest without hubs."""

    def compared(sides: dict[int, list]) -> pa.RecordBatch:
        ids, counts, raw = {}, {}, {}
        for s, rows in sides.items():
            ids[s] = np.concatenate([r[0] for r in rows])
            counts[s] = np.concatenate([r[1] for r in rows])
            raw[s] = np.concatenate([r[2] for r in rows])
        basis = shared.value[raw[0].shape[1]]
        y = {s: unit(x) @ basis for s, x in raw.items()}
        other = 1 if 1 in y else 0
        i, j = linked(y[0], y[other], raw[0], raw[other], threshold)
        every, offset = ids[0], 0
        if other:
            every, offset = np.concatenate((ids[0], ids[1])), len(ids[0])
            number = np.concatenate((np.bincount(i, counts[1][j], len(ids[0])), np.bincount(j, counts[0][i], len(ids[1]))))
        else:
            apart = i != j
            i, j = i[apart], j[apart]
            number = np.bincount(i, counts[0][j], len(ids[0]))
        has = np.flatnonzero(number)
        one, two = spread(every[i], every[j + offset])
        cls = pa.array(np.concatenate((every[has], one)))
        links = pa.array(np.concatenate((number[has].astype(np.int64), np.zeros(len(one), np.int64))))
        root = pa.array(np.concatenate((every[has], two)))
        return pa.RecordBatch.from_arrays([cls, links, root], ["cls", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = np.stack([batch.column(c).to_numpy() for c in ("tile_a", "tile_b")], 1)
            begins = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]).any(1))))
            for a, b in zip(begins, [*begins[1:], len(pair)]):
                now = tuple(pair[a].tolist())
                if now != key and sides:
                    yield compared(sides)
                    sides = {}
                key, part = now, batch.slice(a, b - a)
                side = part.column("side").to_numpy()
                raw = _matrix(part.column("vector"))
                for s in np.unique(side).tolist():
                    own = side == s
                    sides.setdefault(s, []).append((part.column("cls").to_numpy()[own], part.column("n").to_numpy()[own], raw[own]))
        if sides:
            yield compared(sides)

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE, fit: int = FIT) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` per row: its links, the least id that links reach.

    Equal vectors of a label form a class that is compared once and counted by its size. Classes are
    dealt into tiles in the order of the first principal axis; tiles of a label are paired where their ranges on the
    leading axes allow the threshold, by strips of the first axis, so that a hot label's tiles are not paired in one task;
    each pair is one group of at most two tiles of rows.
    Comparing inside a label is quadratic in its distinct vectors where the bounds don't
    part tiles; that work is spread over tile pairs, never over whole labels. Links leave a task as
    counts and a spanning forest without hubs. Vectors move to their class, to their tile and to their pairs of tiles; verdicts come
    back to the rows by a 128-bit key.

    Cases: null label, null vector, zero vector, an empty one, or a null or non-finite component: no links, own
    component, kept. Vectors of one label but different lengths aren't compared. Repeated rows
    link with one another as equal vectors do. A null id counts as a vector but is never the
    component's id unless all ids of it are null; it is ``kept`` only then. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("label").isNotNull() & F.forall("vector", sound) & F.exists("vector", lambda x: x != 0)
    plain = plain.withColumn("vector", F.when(valid, F.col("vector")))
    # 128 bits stand for a label and vector where only the class is asked for; that no two classes share them is checked
    key = lambda lab, vec: (F.xxhash64(lab, vec).alias("k1"), F.xxhash64(F.lit(1), vec, lab).alias("k2"))
    classes = plain.where("vector is not null").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "*", F.size("vector").alias("dim")), "classes")

    bases = {}
    for row in classes.groupBy("dim").count().collect():  # one row per vector length
        part = F.col("dim") == row["dim"]
        share = F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, fit / row["count"]))
        sample = [r.vector for r in classes.where(part & share).select("vector").limit(2 * fit).collect()]
        bases[row["dim"]] = axes(unit(np.array(sample, dtype=np.float64).reshape(-1, row["dim"])) if sample else np.empty((0, row["dim"])))
    shared = spark.sparkContext.broadcast(bases)

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    kind = f"cls long, vector {kinds['vector']}, n long, grp string, dim int"
    lead = ", ".join(f"y{k} double" for k in range(RANGES))
    grouped = classes.select("cls", "vector", "n", F.concat_ws("|", F.col("label").cast("string"), "dim").alias("grp"), "dim")
    placed = grouped.mapInArrow(_leading(shared), f"{kind}, {lead}").repartitionByRange("grp", "y0").sortWithinPartitions("grp", "y0")
    placed = materialize(placed.mapInArrow(_tiles(shared, tile), f"{kind}, {lead}, tile long"), "tiles")

    ranges = [f(f"y{k}").alias(f"{n}{k}") for k in range(RANGES) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    box = placed.groupBy("grp", "tile").agg(*ranges)
    # dealt by strips of the first axis: a box by its own, its partners by all within reach; a pair counts in the first strip of both
    width = float(np.sqrt(2 - 2 * threshold + ROOM)) / STRIPS
    strip = lambda c: F.floor(F.col(c) / width)
    reach = F.sequence(strip("lo0") - STRIPS - 1, strip("hi0") + STRIPS + 1)
    one = box.select("*", strip("lo0").alias("from"), F.explode(F.sequence(strip("lo0"), strip("hi0"))).alias("strip")).alias("a")
    two = box.select("*", (strip("lo0") - STRIPS - 1).alias("from"), F.explode(reach).alias("strip")).alias("b")
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}"))
    apart = sum((gap(k) * gap(k) for k in range(1, RANGES)), gap(0) * gap(0))
    once = F.col("a.strip") == F.greatest("a.from", "b.from")
    near = one.join(two, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.strip") == F.col("b.strip")) & once & (F.col("a.tile") <= F.col("b.tile")) & (apart <= 2 - 2 * threshold + ROOM))
    pairs = materialize(near.select(F.col("a.tile").alias("tile_a"), F.col("b.tile").alias("tile_b")), "pairs")
    sides = pairs.select(F.col("tile_a").alias("tile"), "tile_a", "tile_b", F.lit(0).alias("side")).union(pairs.where("tile_a < tile_b").select("tile_b", "tile_a", "tile_b", F.lit(1)))
    dealt = placed.select("cls", "vector", "n", "tile").join(sides, "tile").repartition("tile_a", "tile_b").sortWithinPartitions("tile_a", "tile_b")
    found = dealt.select("tile_a", "tile_b", "side", "cls", "n", "vector").mapInArrow(_compare(shared, threshold), "cls long, links long, root long")
    found = materialize(found, "links")

    counts = found.groupBy("cls").agg(F.sum("links").alias("others"))
    joined = materialize(components(found.where("cls <> root").select(F.col("cls").alias("src"), F.col("root").alias("dst"))), "components")
    ids = classes.select("cls", "least")
    reached = joined.join(ids, joined.node == ids.cls).groupBy("root").agg(F.min("least").alias("reached"))
    moved = joined.join(reached, "root").select(F.col("node").alias("cls"), "reached")
    answer = classes.select("cls", *key("label", "vector"), "least", "n").join(counts, "cls", "left").join(moved, "cls", "left")
    others = F.coalesce("others", F.lit(0)) + F.col("n") - 1
    one_class = F.when(F.count("*") > 1, F.raise_error(F.lit("two classes of vectors have one key"))).otherwise(F.min(F.coalesce("reached", "least")))
    answer = answer.groupBy("k1", "k2").agg(F.min(others).alias("n_links"), one_class.alias("component_id"))
    answer = materialize(answer, "answer")  # a plain table, so that Spark can split a hot vector's rows in the join
    alone = F.col("vector").isNull()
    out = plain.select("id", alone.alias("alone"), *(F.when(~alone, k).alias(n) for k, n in zip(key("label", "vector"), ("k1", "k2"))))
    out, alone = out.join(answer, ["k1", "k2"], "left"), F.col("alone")
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
