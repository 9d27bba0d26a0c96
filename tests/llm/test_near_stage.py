"""The near-dedup stage joins by operator 10's fingerprints as well as by five-word similarity."""

from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_search import groups, plain_fingerprint

from .test_copies import plain_set, similarity


def test_links_of_either_kind_join(spark):
    line = "every shop in this old town sells fresh bread and cold milk on market days"
    base = [line] * 40 + ["one two three four five six seven"]
    near = [line] * 40 + ["rivers run down from high white mountains toward seas beyond all charts"]  # the repeated line decides the fingerprint, not the set
    long = [f"w{i}" for i in range(120)]
    texts = [" ".join(near), " ".join(base), " ".join(long), " ".join(long[:60] + ["x"] + long[61:]), "", None, "a text of its own"]
    rows = [(10 - i, t) for i, t in enumerate(texts)]
    fps, sets = [plain_fingerprint(t) for t in texts], [plain_set(t) for t in texts]
    bits = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
    alike = lambda a, b: similarity(sets[a], sets[b]) >= 0.8
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    assert any(bits(*p) and not alike(*p) for p in pairs)
    root = groups(len(rows), [p for p in pairs if bits(*p) or alike(*p)])
    want = {}
    for (i, _), g in zip(rows, root):
        want[g] = min(i, want.get(g, i))
    out = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(x.doc_id for x in out) == Counter(want.values())
