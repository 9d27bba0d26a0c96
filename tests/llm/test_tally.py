"""The postings meet every pair that they must, and the tally inside them is what filters."""

import random
from itertools import combinations

import numpy as np

from terrafold.llm import simhash


def test_some_posting_avoids_any_three_bytes():
    assert len(simhash.POSTINGS) == 14
    for k in range(4):
        for bad in combinations(range(8), k):
            assert any(not set(bad) & set(p) for p in simhash.POSTINGS)


def test_tally_equals_brute_force_and_filters():
    r = random.Random(5)
    counted = kept = near = 0
    for n, places in enumerate(simhash.POSTINGS):
        pairs = []
        for _ in range(300):
            a, b = r.getrandbits(64), r.getrandbits(64)
            mask = sum(0xFF << 8 * k for k in places)
            pairs.append((a, (b & ~mask) | (a & mask)))  # met in this posting by chance
            pairs.append((a, a ^ sum(1 << 8 * r.choice([k for k in range(8) if k not in places]) + r.randrange(8) for _ in range(1))))
        a, b = (np.array(x, dtype=np.uint64) for x in zip(*pairs))
        want = [sum((x >> 8 * k) & 255 == (y >> 8 * k) & 255 for k in range(8)) for x, y in pairs]
        got = simhash.shared_bytes(simhash._bytes(a), simhash._bytes(b), np.full(len(a), n))
        assert got.tolist() == want
        left = simhash._retained(a, b, np.full(len(a), n), 3)
        assert left.tolist() == [i for i, (x, y) in enumerate(pairs) if (x ^ y).bit_count() <= 3]
        counted += len(pairs) // 2
        kept += sum(w >= 5 for w in want[::2])
        near += sum((x ^ y).bit_count() <= 3 for x, y in pairs[::2])
    assert kept < counted / 20  # the count alone leaves few of the chance pairs
    assert near <= kept


def test_spread_keeps_groups_without_hubs():
    from terrafold.llm.common import FAN, spread
    from tests.llm.test_search import groups

    r = random.Random(2)
    for links in ([], [(0, i) for i in range(1, 3000)], [(r.randrange(400), r.randrange(400)) for _ in range(300)]):
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        x, y = spread(a, b)
        assert groups(3000, list(zip(x.tolist(), y.tolist()))) == groups(3000, links)
        assert len(x) == 0 or np.unique(np.concatenate((x, y)), return_counts=True)[1].max() <= FAN + 1
