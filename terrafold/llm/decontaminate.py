"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified hits."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_batches, chunks, materialize, text_bytes

#: Word bytes keep their place, A-Z becomes a-z, every other ASCII byte parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words in a text whose letters are still as written.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of test items that one broadcast set holds at most; a larger test set is scanned for in several sets, built one at a time.
#: A set costs its windows' hashes, places and items, 24 bytes a word, and each different word once, some 120 bytes.
SET_WORDS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WindowSet:
    """Windows of the test items as arrays: sorted hashes, where the window stands in the items' word numbers, whose it is."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        own = [np.array([number(w, len(self.vocabulary)) for w in split_words(text)], dtype=np.int32) for _, text in items]
        self.names = [name for name, _ in items]
        self.words = np.concatenate([*own, np.zeros(0, np.int32)])
        counts = np.array([len(x) for x in own], dtype=np.int64)
        begins = np.cumsum(counts) - counts
        lengths = np.minimum(counts, window)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({int(n) for n in lengths if n}):
            of = np.flatnonzero(lengths == size)
            owner = np.repeat(of, counts[of] - size + 1)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            place = begins[owner] + np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            hashes = self.rolled(self.words, size, place)
            order = np.lexsort((*(self.words[place + k] for k in reversed(range(size))), hashes))
            place, owner, hashes = place[order], owner[order], hashes[order]
            new = np.ones(len(order), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            for k in range(size):
                new[1:] |= self.words[place[1:] + k] != self.words[place[:-1] + k]
            at = np.flatnonzero(new)
            self.tables[size] = hashes[at], place[at].astype(np.int32), np.append(at, len(order)).astype(np.int32), owner.astype(np.int32)

    @staticmethod
    def rolled(ids: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
        """Hash of the ``size`` numbers from each place of ``at`` on."""
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = h * BASE + (ids[at + k].astype(np.int64) + 1).astype(np.uint64)
        return h

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """Verified occurrences ``(place, size, items)`` in a row of word numbers; -1 is in no item."""
        out = []
        gaps = np.concatenate(([0], np.cumsum(ids < 0)))
        for size, (known, place, ends, owner) in self.tables.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            h = self.rolled(ids, size, at)
            low = np.minimum(np.searchsorted(known, h), len(known) - 1)
            met = np.flatnonzero(known[low] == h)
            at, h, low = at[met], h[met], low[met]
            while len(at):  # windows of one hash stand side by side
                same = np.ones(len(at), bool)
                for k in range(size):
                    same &= self.words[place[low] + k] == ids[at + k]
                for p, w in zip(at[same].tolist(), low[same].tolist()):
                    out.append((p, size, sorted({n for i in owner[ends[w] : ends[w + 1]].tolist() if (n := self.names[i]) is not None})))
                more = np.flatnonzero(~same & (low + 1 < len(known)))
                more = more[known[low[more] + 1] == h[more]]
                at, h, low = at[more], h[more], low[more] + 1
        return out


SCAN = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = shared.value
        number = known.vocabulary.get
        for batch in chunks(batches, most_bytes=1 << 20):
            words: list[bytes] = []
            ends = []
            for text in text_bytes(batch):
                words += split_words(text)
                ends.append(len(words))
                words.append(b" ")  # in no vocabulary: windows don't reach over it
            ids = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
            ends_ = np.array(ends)
            begins = np.concatenate(([0], ends_[:-1] + 1))
            spans: dict[int, list] = defaultdict(list)
            names: dict[int, set] = defaultdict(set)
            for p, size, items in known.hits(ids):
                row = int(np.searchsorted(ends_, p, side="right"))
                spans[row].append((p - int(begins[row]), p - int(begins[row]) + size))
                names[row].update(items)
            rows = range(batch.num_rows)
            hits = [[{"a": a, "b": b} for a, b in merged(spans[r])] if r in spans else [] for r in rows]
            found = [pa.array(ends_ - begins), pa.array(hits, SCAN.field("hits").type), pa.array([sorted(names[r]) if r in names else [] for r in rows], SCAN.field("items").type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *SCAN.names])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans as disjoint ones in order; spans that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_words(text: str, spans: list) -> str:
    """``text`` without the words of the spans (word numbers) and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        old = batch.column("text").to_pylist()
        new = [t and cut_words(t, [(x["a"], x["b"]) for x in h]) for t, h in zip(old, batch.column("hits").to_pylist())]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))


def _parts(window: int, most: int):
    """Items cut into parts of at most ``most`` words, in which each of an item's windows lies whole; ``n`` words, numbered by ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch)):
                words = split_words(text)
                for k, at in enumerate(range(0, max(1, len(words) - window + 1), most - window + 1) if words else ()):
                    own = words[at : at + most]
                    rows.append((item, b" ".join(own).decode("utf-8", "replace"), len(own), k))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["item", "text", "n", "part"])

    return run


def _groups(most: int):
    """Deal each task's parts into groups of at most ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left = TaskContext.get().partitionId() << 32, most
        for batch in batches:
            out = []
            for n in batch.column("n").to_pylist():
                if n > left:
                    group, left = group + 1, most
                left -= n
                out.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "grp"])

    return run


def _marked(df: DataFrame, known) -> DataFrame:
    """``df`` with its scan for a :class:`WindowSet`, given as such or as a broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(known) if isinstance(known, WindowSet) else known
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_scan(shared), f"{types}, n_words long, hits array<struct<a:long,b:long>>, items array<string>")


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, set_words: int = SET_WORDS) -> DataFrame:
    """``(id, text, n_words, hits, items)`` per row of ``docs``: ``hits`` are the disjoint spans of
    word numbers that lie inside an occurrence of an item's window, ``items`` the items' ids (strings).

    The words of ``benchmark`` are counted first. Up to ``set_words`` of them go out as one broadcast
    set and the scan moves no document. Beyond that executors cut the items into overlapping parts and deal them into sets of at most
    that size; the driver builds and sends one set at a time, the documents are scanned once per set, and only the hits are
    brought together. Memory of the driver and of a task is that of one set either way. Cases: null and empty texts have no words and no hits; an item with
    fewer words than ``window`` is one window, with none it occurs nowhere; repeated documents are
    judged one by one, repeated items count once; an item with a null id counts as hit but can't be named in ``items``;
    columns beyond those named are ignored.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    room = max(set_words, 4 * window)
    parts = items.mapInArrow(_parts(window, max(4 * window, set_words // 64)), "item string, text string, n long, part long")
    parts = parts.dropDuplicates(["item", "text", "part"]).select("item", "text", "n")
    parts = materialize(parts.mapInArrow(_groups(room), "item string, text string, n long, grp long"), "items")
    known = lambda part: WindowSet([(r.item, r.text.encode()) for r in part.select("item", "text").collect()], window)
    sets, left = [], 0
    for grp, n in sorted(parts.groupBy("grp").agg(F.sum("n")).collect()):  # a row a task and set
        if n > left:
            sets.append([])
            left = room
        sets[-1].append(grp)
        left -= n
    if len(sets) < 2:
        return _marked(plain, known(parts))
    plain = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "documents")
    found, counted = [], None
    for own in sets:
        shared = spark.sparkContext.broadcast(known(parts.where(F.col("grp").isin(own))))
        marked = _marked(plain.select("row", "text"), shared).drop("text")
        if counted is None:
            marked = counted = materialize(marked, "counts")
        found.append(materialize(marked.where("size(hits) > 0").select("row", "hits", "items"), "hits"))
        shared.unpersist()
    hit = found[0]
    for part in found[1:]:
        hit = hit.unionByName(part)
    hit = hit.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = "aggregate(hits, cast(array() as array<struct<a:long,b:long>>), (m, x) -> if(size(m) > 0 and x.a <= element_at(m, -1).b, concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, x.b)))), concat(m, array(x))))"
    hit = hit.withColumn("hits", F.expr(join))
    counted = plain.join(counted.select("row", "n_words"), "row").join(hit, "row", "left")
    none = "cast(array() as array<struct<a:long,b:long>>)"
    return counted.select("id", "text", "n_words", F.coalesce("hits", F.expr(none)).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``(id_col, text_col, n_words, n_hit)`` after removal: of the hit words, ``remove="spans"``, or
    of every document with one, ``remove="documents"``. Cases as in :func:`scan_benchmark`."""
    marked = scan_benchmark(docs, benchmark, id_col, text_col, **kw)
    if remove == "documents":
        marked = marked.where("size(hits) = 0")
    elif remove == "spans":
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
        marked = marked.mapInArrow(_cut, types)
    else:
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    return marked.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", n_hit().alias("n_hit"))


def n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The digest of :func:`scan_benchmark`, one row per document."""
    marked = scan_benchmark(docs, benchmark, **kw)
    return marked.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
