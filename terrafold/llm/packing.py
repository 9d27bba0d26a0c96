"""Best-fit packing: vector best-fit of token pieces into sequences under several capacities."""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_batches, chunks, materialize, texts

END = 2
SPECIAL = "<|endoftext|>"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of their parts in the choice of a bin."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    choose: str = "norm"


def tokenizer(vocabulary: str = "byte_bpe_50k"):
    """``encode(text) -> ids`` of the public byte-level BPE.

    The ids are those of the ``tokenizers`` file; the quicker library reads the same vocabulary as ranks. Texts that
    spell the special token go through the file's own library, which gives it its id.
    """
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    with open(public.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = cache(lambda: Tokenizer.from_file(public.path(f"{vocabulary}.json")))  # some 100 MB, for few texts
    return lambda text: slow().encode(text, add_special_tokens=False).ids if SPECIAL in text else quick.encode_ordinary(text)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: all of ``most``, but the first may be shorter."""
    first = n % most or most
    return [(0, first)] + [(a, most) for a in range(first, n, most)]


PIECE = "piece int, start long, length long, ids_crc32 long, task int, turn long"


def _pieces(vocabulary: str, most: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in chunks(batches):
            row, out, tokens = [], [], []
            for r, text in enumerate(texts(batch)):
                ids = np.array([*encode(text), END], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    own = ids[start : start + length]
                    row.append(r)
                    out.append((piece, start, length, zlib.crc32(own.tobytes()), task, seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        tokens.append(own.astype(np.int32))
            cols = list(zip(*out))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [batch.column("id").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "turn"]
            if keep_ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def plan(counts: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Vector best-fit decreasing over a histogram of piece lengths.

    Returns slots ``(length, low, high, sequence, offset)``: of the pieces of that length, numbered
    from 0, number ``k`` with ``low <= k < high`` goes to sequence ``sequence + k - low`` at ``offset``.
    Bins with equal residuals form a class with a count, so the work and the number of slots follow
    the number of different lengths (at most ``limits.tokens``), not that of pieces: a step ends a
    class or a length, and a length opens at most one class and splits at most one more each time.
    """
    full = np.array([limits.tokens, limits.documents, limits.cost], dtype=np.float64)
    weight = np.array(limits.weights)
    residual, size, base, filled = np.empty((0, 3)), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    slots, opened = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        need = np.array([length, 1, length * length], dtype=np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        left, taken = counts[length], 0
        while left:
            fits = np.flatnonzero((residual >= need).all(1))
            if len(fits):
                after = (residual[fits] - need) / full
                if limits.choose == "norm":
                    score = -np.sqrt((weight * after**2).sum(1))
                else:  # the residual whose direction matches the piece best
                    unit = residual[fits] / full
                    score = (weight * unit * (need / full)).sum(1) / np.sqrt((weight * unit**2).sum(1))
                best = fits[int(np.argmax(score))]
                k = int(min(left, size[best]))
                slots.append((length, taken, taken + k, int(base[best]), int(filled[best])))
                new = (residual[best] - need, k, base[best], filled[best] + length)
                size[best] -= k
                base[best] += k
            else:
                each = int(min(full // need))
                k = math.ceil(left / each)
                slots.append((length, taken, taken + k, opened, 0))
                new = (full - need, k, opened, length)
                opened += k
            left -= k
            taken += k
            keep = size > 0
            residual = np.vstack([residual[keep], new[0]])
            size, base, filled = (np.append(x[keep], y) for x, y in zip((size, base, filled), new[1:]))
            # full bins take nothing more
            alive = (residual[:, 0] > 0) & (residual[:, 1] > 0)
            residual, size, base, filled = residual[alive], size[alive], base[alive], filled[alive]
    return slots


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), vocabulary: str = "byte_bpe_50k", keep_ids: bool = False) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)`` per piece, with ``ids`` on demand.

    A document's tokens end with id 2; longer ones than a sequence are cut. Pieces are numbered per
    length without a global sort: each task numbers its own, the tasks' counts are summed up per
    length, and the bins are planned on the histogram of lengths alone, at most ``limits.tokens`` numbers for the driver.
    The planned slots, bounded likewise, are joined to the pieces. Pieces move once, for their tasks' counts. Cases: a null or
    empty text is the end token alone; repeated rows and null ids are packed like others, one piece
    set per row; an empty table packs nothing; other columns are ignored.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = plain.schema["id"].dataType.simpleString()
    cols = f"id {id_type}, {PIECE}" + ", ids array<int>" * keep_ids
    pieces = materialize(plain.mapInArrow(_pieces(vocabulary, limits.tokens, keep_ids), cols), "pieces")
    by_task = pieces.groupBy("length", "task").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = materialize(by_task.select("length", "task", "count", F.coalesce(before, F.lit(0)).alias("before")), "tasks")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, limits) or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    # as many rows as tasks times lengths: dealt, not broadcast; a hot length is split by its tasks
    numbered = pieces.join(by_task.drop("count").hint("shuffle_hash"), ["length", "task"]).withColumn("k", F.col("before") + F.col("turn"))
    placed = numbered.join(F.broadcast(slots), "length").where("k >= low and k < high")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k") - F.col("low")).alias("sequence_id"), "offset", *(["ids"] if keep_ids else [])
    )
