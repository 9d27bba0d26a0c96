"""Near copies by five-word similarity: MinHash bands retrieve, exact set similarity verifies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_batches, chunks, components, materialize, spread, text_bytes, union_roots
from terrafold.llm.simhash import LOWER, SEED

WIDTH, SIMILAR = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99994 at 0.8.
BANDS, ROWS = 32, 6
#: Texts of one side that a task compares at a time.
TILE = 128
#: Bits of the filter that leaves texts aside which share no band with another; only its cost depends on it.
FILTER_BITS = 1 << 24

BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of every ``width`` words, in order; a shorter text is one shingle, a blank one has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = x * BASE + own[k : k + n]
    return np.unique(_mixed(x))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band, of the least shingles under the band's hash functions; none for an empty set."""
    if not len(shingles):
        return shingles
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * FACTORS).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * BASE + column)
    return key


def _set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = [shingle_set(t) for t in text_bytes(batch)]
        fps = np.fromiter(map(_set_hash, sets), np.uint64, len(sets))
        bands = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64)), bands], ["id", "fp", "bands"])


def _sets(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, set()
        for batch in chunks(batches):
            found = {}
            for text in text_bytes(batch):
                own = shingle_set(text)
                fp = _set_hash(own)
                bit = fp % FILTER_BITS
                if fp not in seen and wanted[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1):
                    seen.add(fp)
                    found[fp] = own.tobytes()
            fps = np.fromiter(found, np.uint64, len(found))
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(list(found.values()), pa.binary())], ["fp", "own"])

    return run


def _filter(candidates: DataFrame) -> np.ndarray:
    """A bit for each candidate, by the low bits of its hash."""
    low = F.col("fp").bitwiseAND(FILTER_BITS - 1)
    bit = F.expr("shiftleft(1L, cast(fp & 63 as int))")
    words = candidates.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _slot_links(rows: list[tuple], similar: float) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs between the two sides of one slot; texts of one ``root`` are joined already."""
    one = [r for r in rows if r[0] == 0]
    two = [r for r in rows if r[0] == 1]
    if not one or not two:
        return []
    names = {fp: i for i, fp in enumerate(dict.fromkeys(r[1] for r in rows))}
    first: dict[int, int] = {}
    joined = [(first.setdefault(r[2], names[r[1]]), names[r[1]]) for r in rows]
    roots = union_roots(np.arange(len(names)), *np.array(joined).T)
    sets = [np.frombuffer(r[3], np.uint64) for r in two]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    every, at = np.concatenate(sets), np.array([names[r[1]] for r in two])
    out = []
    for _, fp, _, own in one:
        i, a = names[fp], np.frombuffer(own, np.uint64)
        if (roots[at] == roots[i]).all():
            continue
        hit = a[np.minimum(np.searchsorted(a, every), len(a) - 1)] == every
        common = np.add.reduceat(hit, starts, dtype=np.int64)
        near = np.flatnonzero((common / (len(a) + sizes - common) >= similar) & (roots[at] != roots[i]))
        for k in near:
            if roots[at[k]] != roots[i]:
                out.append((fp, two[k][1]))
                roots = union_roots(roots, np.array([i]), at[k : k + 1])
    if not out:
        return out
    a, b = spread(*np.array(out, dtype=np.int64).T)
    return list(zip(a.tolist(), b.tolist()))


def _slots(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot = [], None

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "one", "two", "side", "fp", "root", "own")]
            links = []
            for key, one, two, *row in zip(*cols):
                if (key, one, two) != slot:
                    links += _slot_links(held, similar)
                    held, slot = [], (key, one, two)
                held.append(tuple(row))
            yield batch_of(links)
        yield batch_of(_slot_links(held, similar))

    return run


def _compared(members: DataFrame, sets: DataFrame, similar: float, tile: int) -> DataFrame:
    """Links ``(src, dst)`` between the members of a bucket with ``rest`` and all its members, by exact similarity.

    ``members(key, fp, root, rest, n, k)``: ``n`` members of which ``k`` have ``rest``. Both sides are cut into tiles, each pair of tiles
    a slot of its own, so that a large bucket is many groups.
    """
    tiles = {"one": F.ceil(F.col("k") / tile), "two": F.ceil(F.col("n") / tile)}
    own = {c: F.pmod(F.xxhash64("fp"), t) for c, t in tiles.items()}
    all_ = {c: F.explode(F.sequence(F.lit(0).cast("long"), t - 1)) for c, t in tiles.items()}
    side = lambda df, k, one, two: df.select("key", "fp", "root", F.lit(k).alias("side"), one.alias("one"), two.alias("two"))
    both = side(members.where("rest"), 0, own["one"], all_["two"]).union(side(members, 1, all_["one"], own["two"]))
    dealt = both.join(sets, "fp").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return dealt.select("key", "one", "two", "side", "fp", "root", "own").mapInArrow(_slots(similar), "src long, dst long")


def similar_links(plain: DataFrame, distinct: DataFrame, similar: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """Links ``(src, dst)`` that span every group of shingle sets joined by similarities of ``similar`` or more.

    ``distinct(fp, bands)`` has one row per set, ``plain(text)`` the texts. Sets that share a band form a bucket;
    buckets of the same members are compared once. First each bucket's members meet one of them, another in each
    bucket, which joins a large group of copies by linear work; then, in the buckets that are still in several groups,
    all members outside the largest group meet all members. Every pair of a bucket is so compared exactly or joined already.
    """
    index = distinct.select("fp", F.explode("bands").alias("key"))
    shared = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min_by("fp", F.xxhash64("fp", "key")).alias("hub"))
    shared = shared.where("n > 1").groupBy("n", "low", "x").agg(F.min_by("hub", "key").alias("hub"), F.min("key").alias("key"))
    members = materialize(index.join(shared.select("key", "n", "hub"), "key"), "members")
    wanted = plain.sparkSession.sparkContext.broadcast(_filter(members.select("fp").distinct()))
    sets = plain.select("text").mapInArrow(_sets(wanted), "fp long, own binary")
    sets = materialize(sets.groupBy("fp").agg(F.first("own").alias("own")), "sets")
    star = members.select("key", "fp", F.col("fp").alias("root"), (F.col("fp") == F.col("hub")).alias("rest"), "n", F.lit(1).alias("k"))
    star = materialize(_compared(star, sets, similar, tile), "star")
    found = materialize(components(star), "joined").select(F.col("node").alias("fp"), "root")
    open_ = members.where("n > 2").select("key", "fp").join(found, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    open_ = materialize(open_, "open")
    parts = open_.groupBy("key", "root").agg(F.count("*").alias("c"))
    parts = parts.groupBy("key").agg(F.count("*").alias("groups"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("main")).where("groups > 1")
    parts = parts.select("key", "n", (F.col("n") - F.col("main.c")).alias("k"), F.col("main.root").alias("main"))
    parts = materialize(parts, "parts")  # a plain table, so that Spark can split a hot bucket's rows in the join
    rest = open_.join(parts, "key").select("key", "fp", "root", (F.col("root") != F.col("main")).alias("rest"), "n", "k")
    return star.union(_compared(rest, sets, similar, tile))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """``(id_col, component_id, kept)``, one row per row of ``docs``.

    Texts link where their sets of five-word shingles (lower-cased) have a Jaccard similarity of ``similar`` or more; ``component_id`` is
    the least id that links reach. Candidates come from MinHash bands, so a pair of exactly 0.8 is met with probability 0.99994, closer
    ones with more; each is then compared exactly. Cases: a text with fewer than five words is one shingle; null and blank texts have
    none and are copies of one another; a null id never becomes a ``component_id`` unless its whole component has null ids, and isn't
    ``kept`` otherwise; of repeated rows of one id all are ``kept`` alike; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = plain.schema["id"].dataType.simpleString()
    marked = materialize(plain.mapInArrow(_marks, f"id {id_type}, fp long, bands array<long>"), "marks")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "distinct")
    joined = materialize(components(similar_links(plain, distinct, similar, tile)), "components")
    least = joined.join(distinct, joined.node == distinct.fp).groupBy("root").agg(F.min("rep").alias("least"))
    moved = joined.join(least, "root").select(F.col("node").alias("fp"), "least")
    by_fp = distinct.select("fp", "rep").join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    by_fp = materialize(by_fp, "by_fp")  # a plain table, so that Spark can split a hot set's rows in the join
    return marked.select("id", "fp").join(by_fp, "fp", "left").select(F.col("id").alias(id_col), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
