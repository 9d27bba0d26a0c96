"""Kinds of the spans that the field adds, against enumeration of all labelings."""

import itertools
import math

import pytest

from terrafold.llm import pii

TEXTS = {
    "write to ana.lee7@mail.example.com now. later ana.lee7 again": ["email"],
    "ana.lee7@mail.example.com or ana.lee7@b.example.org: ana.lee7, or ana.lee7!": None,
    "+1 (212) 555-0101; then 555-0101 alone, and 5550101": None,
    "call +44 20 7946 0958 or 7946-0958": None,
    "user z-91 z-91 id 123456789": None,
    "card 4111 1111 1111 1111 and 41111111": None,
}


def plain_kinds(text):
    base = pii.base_spans(text)
    added = pii.linked_spans(text, base)
    taken = [(a, b, k) for k, own in enumerate(base.values()) for a, b in own]
    nodes = []
    for m in pii.CANDIDATE.finditer(text):
        hit = [k for a, b, k in sorted(taken) if a < m.end() and m.start() < b]
        if hit:
            nodes.append((m[0], [pii.CLAMP * (k == hit[0]) for k in range(4)]))
    first = len(nodes)
    nodes += [(text[a:b], pii.shape(text[a:b])) for a, b in added]
    hubs = {}
    for n, (token, _) in enumerate(nodes):
        for key in pii.similar(token):
            hubs.setdefault(key, []).append(n)
    groups = [g for g in hubs.values() if len(g) > 1]
    mass = [[0.0] * 4 for _ in nodes]
    for ys in itertools.product(range(4), repeat=len(nodes)):
        own = sum(u[y] for (_, u), y in zip(nodes, ys))
        w = math.exp(own) * math.prod(sum(math.exp(pii.SKIP * sum(ys[n] == h for n in g)) for h in range(4)) for g in groups)
        for n, y in enumerate(ys):
            mass[n][y] += w
    return [pii.KINDS[max(range(4), key=m.__getitem__)] for m in mass[first:]], added


@pytest.mark.parametrize("text", TEXTS)
def test_kinds_agree_with_enumeration(text):
    want, added = plain_kinds(text)
    assert pii.linked_kinds(text, pii.base_spans(text), added) == want
    assert TEXTS[text] in (None, want)


def test_clean_names_the_kind(spark):
    rows = [(1, "write to ana.lee7@mail.example.com now. later ana.lee7 again"), (2, "no data"), (3, None), (4, "+1 (212) 555-0101; then 555-0101 alone")]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].clean == "write to [EMAIL] now. later [EMAIL] again" and got[1].linked_kinds == "email"
    assert got[2].clean == "no data" and got[2].linked_kinds == "" and got[3].clean is None
    assert got[4].clean == "[PHONE]; then [PHONE] alone"
