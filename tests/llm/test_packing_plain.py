"""Packing against a plain best fit, and the quick tokenizer against the contract's."""

import random
from collections import Counter

import pytest

from terrafold.llm import packing


def plain_bins(lengths, lim):
    """Best-fit decreasing, one piece at a time, by the score of ``packing.plan``."""
    full = (lim.tokens, lim.documents, lim.cost)
    bins = []
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        best = None
        for i, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                if lim.choose == "norm":
                    score = -sum(w * ((x - y) / f) ** 2 for w, x, y, f in zip(lim.weights, left, need, full)) ** 0.5
                else:
                    u = [x / f for x, f in zip(left, full)]
                    score = sum(w * a * y / f for w, a, y, f in zip(lim.weights, u, need, full)) / sum(w * a * a for w, a in zip(lim.weights, u)) ** 0.5
                if best is None or score > best[0] + 1e-12:
                    best = (score, i)
        if best is None:
            bins.append([f - y for f, y in zip(full, need)])
        else:
            bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need)]
    return bins


#: Tokens bind alone, documents too, cost too, and all three in one set of pieces.
LIMITS = [(100, 100, 10_000), (100, 4, 10_000), (100, 50, 3_600), (100, 6, 4_200)]


@pytest.mark.parametrize("choose", ["norm", "dot"])
@pytest.mark.parametrize("limits", LIMITS)
def test_as_few_bins_as_a_plain_best_fit(limits, choose):
    r = random.Random(9)
    lim = packing.Limits(*limits, weights=(1.0, 1.0, 1.0), choose=choose)
    lengths = [min(60, int(r.expovariate(0.06)) + 1) for _ in range(600)]
    slots = packing.plan(Counter(lengths), lim)
    used = {first + k for _, low, high, first, _ in slots for k in range(high - low)}
    bins = plain_bins(lengths, lim)
    assert abs(len(used) - len(bins)) <= max(1, len(bins) // 100)


def test_all_three_capacities_bind():
    r = random.Random(9)
    lim = packing.Limits(*LIMITS[-1], weights=(1.0, 1.0, 1.0))
    lengths = [min(60, int(r.expovariate(0.06)) + 1) for _ in range(600)]
    alone = set()  # capacities that alone keep some piece out of some bin
    for left in plain_bins(lengths, lim):
        for n in set(lengths):
            lacks = [k for k, (x, y) in enumerate(zip(left, (n, 1, n * n))) if x < y]
            alone |= set(lacks) if len(lacks) == 1 else set()
    assert alone == {0, 1, 2}


def test_quick_ids_are_the_contracts(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    encode, slow = packing.tokenizer(), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for table in ("documents", "benchmark", "conversations"):
        for row in spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").select("text").distinct().collect():
            assert list(encode(row.text or "")) == slow.encode(row.text or "", add_special_tokens=False).ids
