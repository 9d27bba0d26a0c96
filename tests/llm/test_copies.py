"""Near copies against brute force over exact sets of five words."""

import random
from collections import Counter

import pytest

from terrafold.llm import copies
from tests.llm.test_search import groups, least, odd_docs

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").encode().translate(copies.LOWER).split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_copies(rows):
    sets = [plain_set(t) for _, t in rows]
    n = len(rows)
    root = groups(n, [(a, b) for a in range(n) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8])
    members = {k: least([rows[i][0] for i in range(n) if root[i] == k]) for k in set(root)}
    return Counter((rows[i][0], members[root[i]]) for i in range(n))


@pytest.mark.parametrize("tile", [3, 128])
def test_near_copies_equal_brute_force(spark, tile):
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, t) for i, t, *_ in odd_docs()]
    base = [r.choice(words) for _ in range(120)]
    for i in range(60):  # copies of copies: pairs on both sides of 0.8
        own = base[:]
        for _ in range(r.randrange(1, 5)):
            own[r.randrange(120)] = r.choice(words)
        rows.append((1000 + i, " ".join(own)))
        base = own if i % 7 == 0 else base
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    got = copies.near_copies(df, tile=tile).collect()
    assert Counter((x.doc_id, x.component_id) for x in got) == plain_copies(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    assert copies.near_copies(df.limit(0)).count() == 0


def test_the_stage_takes_copies_of_more_than_three_bits(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and doc_id is not null")
    want = plain_copies([(x.doc_id, x.text) for x in docs.collect()])
    kept = {x.doc_id for x in cp.near_dedup(spark, docs, SF).collect()}
    assert kept == {i for i, first in want if i == first}
    assert 6 in kept and 145 not in kept  # similarity 0.833, 7 bits of op10's fingerprints
