"""SimHash near-dedup: byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_batches, chunks, components, materialize, spread, text_bytes, union_roots

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Distinct fingerprints that one task compares with one another; larger buckets become tile pairs.
TILE = 4096
#: Buckets up to this size are compared by shifted copies of the whole batch.
SMALL = 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 majority bits over the XXH64 of every shingle of ``width`` words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        size = min(1 << 16, n - at)
        hashes = np.fromiter((digest(joined[a:b], SEED) for (a, b), _ in zip(spans, range(size))), np.uint64, size)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = np.fromiter((fingerprint(t, width) for t in text_bytes(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


#: Positions of the bytes that a posting holds. These 14 fours are the ones whose numbers xor to 0: every three positions lie in
#: exactly one of them, and with a four its other four is among them too, so whichever three bytes differ, some posting has none of them.
POSTINGS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def _bytes(fps: np.ndarray) -> np.ndarray:
    """The 8 positional bytes of each fingerprint, lowest first."""
    return np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(-1, 8)


def shared_bytes(a: np.ndarray, b: np.ndarray, posting: np.ndarray) -> np.ndarray:
    """Tally of the shared positional bytes of pairs met in a posting: its own four, and those among the other four that are equal.

    ``a`` and ``b`` are bytes of shape ``(..., 8)``; ``posting`` numbers each pair's posting, a scalar for all.
    """
    own = np.zeros((len(POSTINGS), 8), bool)
    for k, places in enumerate(POSTINGS):
        own[k, list(places)] = True
    return 4 + ((a == b) & ~own[posting]).sum(-1, dtype=np.int64)


def _retained(a: np.ndarray, b: np.ndarray, posting: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the pairs that reach the guaranteed number of shared bytes and then differ in ``max_bits`` bits or fewer."""
    counted = np.flatnonzero(shared_bytes(_bytes(a), _bytes(b), posting) >= 8 - max_bits)
    return counted[np.bitwise_count(a[counted] ^ b[counted]) <= max_bits]


def _bucket_links(key: np.ndarray, posting: np.ndarray, part: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each bucket. ``key`` is sorted; ``part`` tells the tile's side."""
    n = len(key)
    roots = np.arange(n)
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((begins, [n])))
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, n)):
        a = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(a):
            break
        a = a[_retained(fps[a], fps[a + d], posting[a], max_bits)]
        roots = union_roots(roots, a, a + d)
    for at, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL]):
        whole = np.arange(at, at + size)
        sides = [whole[part[whole] == p] for p in np.unique(part[whole])]
        one, two = (sides[0], sides[-1])
        for i in range(0, len(one), 128):
            block = one[i : i + 128]
            tally = shared_bytes(_bytes(fps[block])[:, None], _bytes(fps[two])[None], posting[at])
            a, b = np.nonzero(tally >= 8 - max_bits)
            near = np.bitwise_count(fps[block[a]] ^ fps[two[b]]) <= max_bits
            roots = union_roots(roots, block[a[near]], two[b[near]])
    moved = np.flatnonzero(roots != np.arange(n))
    return spread(fps[moved], fps[roots[moved]])


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def found(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, tile, part, fps = (np.concatenate(x) for x in zip(*rows))
            # a bucket of several tiles is one group per pair of tiles
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
            a, b = _bucket_links(group, key >> 32, part, fps.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(c).to_numpy() for c in ("key", "tile", "part", "fp"))
            # the last group may go on in the next batch
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield found([*held, tuple(x[:cut] for x in rows)])
                held = []
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield found(held)

    return run


def near_links(distinct: DataFrame, max_bits: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``(src, dst)`` that span every group of fingerprints joined by ``max_bits`` or fewer bits.

    ``distinct`` has one row per fingerprint ``fp`` (long). Two fingerprints within 3 bits share at least 5 of their 8
    positional bytes. The inverted index has a posting for each of ``POSTINGS``, four bytes and where they stand, and every such pair
    meets in one at least. There the pair's shared bytes are tallied: the posting's four and what else is equal. A pair met by
    chance seldom shares one more, so the count leaves about one in 64 of them; those with the guaranteed 5 have their bits
    compared. The tally stays inside a posting, since a group of near copies must not be expanded into pairs for a shuffle. A posting larger
    than ``tile`` is split into pairs of tiles, each its own group. Only a spanning forest leaves a group.
    Of N random fingerprints about 14 N^2 / 2^33 pairs meet: fewer than N up to some 10^8.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the postings guarantee up to 3 bits")
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(0xFF)
    keys = [sum((byte(k) * 256**j for j, k in enumerate(places)), F.lit(n * 2**32)) for n, places in enumerate(POSTINGS)]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = index.groupBy("key").count().where(F.col("count") > tile)
    large = large.select("key", F.ceil(F.col("count") / tile).alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    index = index.join(large, "key", "left").select("fp", "key", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    index = index.select("fp", "key", "tiles", own.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    index = index.select("fp", "key", "part", (F.least("part", "other") * F.col("tiles") + F.greatest("part", "other")).alias("tile"))
    dealt = index.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.select("key", "tile", "part", "fp").mapInArrow(_links(max_bits), "src long, dst long")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """``(id_col, fingerprint, component_id, kept)``, one row per row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is the least id that
    links reach. Cases: a null or blank text has fingerprint zero and links like any other; rows
    with equal texts (also repeated rows) share a fingerprint and so a component; a null id never
    becomes a ``component_id`` unless its whole component has null ids, and isn't ``kept`` otherwise;
    of repeated rows of one id all are ``kept`` alike; an empty table gives an empty result; other columns
    of ``docs`` are ignored whatever their names.
    """
    bounded_batches(docs)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = plain.schema["id"].dataType.simpleString()
    marked = materialize(plain.mapInArrow(_fingerprints(width), f"id {id_type}, fp long"), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    joined = components(near_links(distinct.select("fp"), max_bits))
    joined = materialize(joined, "components")
    least = joined.join(distinct, joined.node == distinct.fp).groupBy("root").agg(F.min("rep").alias("least"))
    moved = joined.join(least, "root").select(F.col("node").alias("fp"), "least")
    by_fp = distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    by_fp = materialize(by_fp, "by_fp")  # a plain table, so that Spark can split a hot fingerprint's rows in the join
    return marked.join(by_fp, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
