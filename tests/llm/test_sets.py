"""Benchmark sets of a bounded size: their bytes, and items larger than a set."""

import pickle
import random
from collections import Counter

import numpy as np
import pytest

from terrafold.llm import decontaminate
from tests.llm.test_search import plain_report


def test_bytes_a_word():
    r = random.Random(1)
    items = [(str(i), " ".join(f"w{r.randrange(2000)}" for _ in range(100)).encode()) for i in range(1000)]
    known = decontaminate.WindowSet(items)
    held = sum(x.nbytes for t in known.tables.values() for x in t) + known.words.nbytes
    assert held <= 28 * 100_000 and len(pickle.dumps(known)) <= 40 * 100_000


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate.WindowSet, "rolled", staticmethod(lambda ids, size, at: np.zeros(len(at), np.uint64)))
    items = [("a", b"one two three"), ("b", b"two three one"), ("c", b"one two three"), ("d", b"four five six")]
    known = decontaminate.WindowSet(items)
    ids = np.array([known.vocabulary.get(w, -1) for w in b"x two three one two three".split()])
    assert [(p, size, names) for p, size, names in sorted(known.hits(ids))] == [(1, 3, ["b"]), (3, 3, ["a", "c"])]


@pytest.mark.parametrize("set_words", [120, 300])
def test_items_larger_than_a_set(spark, set_words):
    r = random.Random(7)
    long = " ".join(f"t{r.randrange(60)}" for _ in range(500))
    words = long.split()
    items = [(1, long), (2, " ".join(words[100:140])), (3, "odd one out"), (3, "odd one out"), (None, "a b"), (4, long)]
    docs = [(i, " ".join(["x", *words[i * 9 : i * 9 + 9 + i], "y"])) for i in range(40)] + [(90, long), (91, "odd one out a b"), (92, None)]
    got = decontaminate.decontamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), set_words=set_words).collect()
    want = Counter()
    for i, t in docs:
        n, hit, _, _, bad = plain_report(t, [(k, x) for k, x in items])
        named = plain_report(t, [(k, x) for k, x in items if k is not None])
        want[i, n, hit, named[2], named[3], bad] += 1
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == want
