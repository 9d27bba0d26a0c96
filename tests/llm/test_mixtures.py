"""Mixtures against expectation-maximisation written out, one document and one unit at a time."""

import math
import random

import numpy as np
import pytest

from terrafold.llm import languages


def plain_fit(units, allowed):
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(languages.ROUNDS):
        posts = []
        for u in units:
            top = max(u)
            joint = {k: share[k] * math.exp(u[k] - top) for k in allowed}
            total = sum(joint.values())
            posts.append({k: v / max(total, 1e-300) for k, v in joint.items()})
        share = {k: sum(p[k] for p in posts) / len(units) for k in allowed}
    return share, sum(math.log(max(sum(share[k] * math.exp(u[k] - max(u)) for k in allowed), 1e-300)) for u in units)


def plain_mixture(units):
    """Start with all languages; leave out the least while the penalised likelihood allows it."""
    allowed = list(range(len(units[0])))
    share, value = plain_fit(units, allowed)
    while len(allowed) > 1:
        least = min(allowed, key=lambda k: share[k])
        fewer = [k for k in allowed if k != least]
        share2, value2 = plain_fit(units, fewer)
        if value2 + languages.PENALTY * math.log(len(units) + 1) < value:
            break
        allowed, share, value = fewer, share2, value2
    return [share.get(k, 0.0) for k in range(len(units[0]))]


def test_mixtures_equal_plain_em():
    r = random.Random(4)
    docs = []
    for _ in range(60):
        langs = r.randrange(1, 5)
        weight = [r.random() ** 3 for _ in range(5)]
        units = []
        for _ in range(r.choice([1, 2, 5, 30])):
            true = r.choices(range(5), weight)[0] % langs
            units.append([-40 - 25 * r.random() - (0 if k == true else 20 * r.random()) for k in range(5)])
        docs.append(units)
    begins = np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1]))
    got = languages.mixtures(np.array([u for d in docs for u in d]), begins)
    for row, units in zip(got, docs):
        assert row.tolist() == pytest.approx(plain_mixture(units), abs=1e-9)


def test_every_gram_counts_or_the_fit_fails(spark):
    rows = [(i, chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i) + chr(0x4E02 + 3 * i), "zz") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(languages.fit(df).grams) == 3 * 400
    with pytest.raises(ValueError, match="n-grams"):
        languages.fit(df, grams=1199)


def test_one_text_in_a_third_of_the_rows(spark):
    r = random.Random(6)
    words = {"aa": ["kato", "moka", "tiko", "pamo"], "bb": ["wurz", "schlu", "zwerg", "grol"]}
    hot = " ".join(r.choice(words["aa"]) for _ in range(30))
    rows = [(i, hot if i % 3 == 0 else " ".join(r.choice(words["aabb"[i % 2 * 2 : i % 2 * 2 + 2]]) for _ in range(30)), "aa" if i % 3 == 0 else "aabb"[i % 2 * 2 : i % 2 * 2 + 2]) for i in range(3000)]
    model = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=600)
    assert model.langs == ["aa", "bb"]
    known = lambda text: languages.mixtures(model.units(text), np.array([0])).argmax()
    assert known("moka tiko pamo kato") == 0 and known("zwerg grol wurz schlu") == 1
