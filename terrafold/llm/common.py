"""What the operators share: Arrow batches of texts, groups within a batch, and the library's tables and components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from terrafold.operators.graph import components
from terrafold.operators.tables import collect_garbage, discard, materialize, table

__all__ = ["bounded_batches", "chunks", "collect_garbage", "components", "discard", "materialize", "spread", "table", "text_bytes", "texts", "union_roots"]

#: Links to lower members that one member of a group has at most, in what :func:`spread` makes of the group.
FAN = 32


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> None:
    """Let the session send Arrow batches of at most about ``BATCH_BYTES``, whatever a row holds; a smaller bound of its own stays.

    A batch is held by Spark, by the transfer and by Python at once, in each task; the default bound is by rows, whatever their texts' size.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = conf.get(name, None)
    if given is None or not given.rstrip("bB").isdigit() or not 0 < int(given.rstrip("bB")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces with about ``most_bytes`` of text each, one row at least; after the last one :func:`give_back`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        block = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return to the system what this process has freed: a Python worker serves many tasks and would keep the most that one of them took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; a null is an empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of the texts of a batch; a null is an empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def union_roots(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the groups of ``a[i]`` and ``b[i]``; ``roots`` maps each index to its group's least index."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return roots
        np.minimum.at(roots, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := roots[roots], roots):
            roots = up


def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Other links with the same groups as ``(a[i], b[i])``: each group as a tree of ``FAN`` branches, so that no member is a hub."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    roots = union_roots(np.arange(len(nodes)), *np.split(place, 2))
    order = np.argsort(roots, kind="stable")
    begins = np.flatnonzero(np.diff(roots[order], prepend=-1))
    first = np.repeat(begins, np.diff(np.append(begins, len(order))))
    rank = np.arange(len(order)) - first
    child = np.flatnonzero(rank)
    return nodes[order[child]], nodes[order[first[child] + (rank[child] - 1) // FAN]]
