"""Whole license texts, edited and cut, inside other text."""

import random

from terrafold.llm import licenses


def test_edited_and_cut_texts(spark):
    r = random.Random(5)
    noise = lambda n: " ".join(r.choice(["foo", "bar", "under", "9", "license"]) for _ in range(n))
    rows, want = [], {}
    for name, text in licenses.LICENSES.items():
        w = text.split()
        for kind in ("whole", "edited", "cut", "half"):
            own = w[:]
            if kind == "edited":  # each edit costs five shingles
                for k in r.sample(range(5, len(w) - 5), max(1, len(w) // 60)):
                    own[k] = "EDITED"
            own = {"cut": own[: int(len(w) * 0.88)], "half": own[: len(w) // 2]}.get(kind, own)
            body = " ".join(own)
            held = licenses.shingles(licenses.norm_words(body)) & (whole := licenses.shingles(licenses.norm_words(text)))
            rows.append((len(rows), f"{noise(40)} {body} {noise(60)}"))
            want[rows[-1][0]] = name, kind, len(held) / len(whole)
    got = {x.doc_id: {y.name: y.containment for y in x.licenses} for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, kind, share) in want.items():
        assert (name in got[i]) == (share >= 0.8), (name, kind, share)
        if share >= 0.8:
            assert abs(got[i][name] - share) < 0.02
    assert {kind for _, kind, share in want.values() if 0.8 <= share < 1} == {"edited", "cut"}
