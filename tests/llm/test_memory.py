"""What a stage or a task took is given back: the executors' heaps before a stage, a worker's memory after its last batch."""

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from terrafold.llm import common

SF = "/root/testdata/sf0.001"


def collected(spark):
    """Full collections so far; in local mode the executor is the driver's JVM."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_a_stage_begins_with_a_collected_heap(spark, monkeypatch, name, stage):
    docs = spark.createDataFrame([(1, "a text of its own", "en", "s", 17)], "doc_id long, text string, lang string, source string, n_chars long")
    before = collected(spark)
    assert [x.doc_id for x in stage(spark, docs, SF).collect()] == [1]
    assert collected(spark) > before


def test_chunks_give_back_after_the_last_batch(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "c"]})
    assert [b.num_rows for b in common.chunks([batch, batch.slice(0, 0), batch], most_bytes=2)] and said == [1]


def test_give_back_returns_freed_memory():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
    held = [bytes(50_000) for _ in range(4000)]  # 200 MB in pieces too small for maps of their own
    last = bytes(50_000)  # keeps the heap's end in use
    most = resident()
    held.clear()
    common.give_back()
    assert resident() < most - 120 and last is not None
