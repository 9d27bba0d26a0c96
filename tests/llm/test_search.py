"""Near-dedup, decontamination and packing against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from terrafold.llm import common, decontaminate, embeddings, packing, simhash

DOCS = "doc_id long, text string, id string, fp string, row int"


def odd_docs(seed=1):
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "éclair", "x1", "naïve", "zz"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "two words"), (6, "two  WORDS"), (6, "two  WORDS"), (None, "two words"), (7, "x" * 50_000), (8, "long " * 20_000)]
    base = [r.choice(words) for _ in range(400)]
    for i in range(40):
        own = base[:]
        for _ in range(r.randrange(6)):
            own[r.randrange(400)] = r.choice(words)
        rows.append((100 + i, " ".join(own)))
    rows += [(200 + i, " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))) for i in range(60)]
    return [(i, t, "clash", "clash", 0) for i, t in rows]


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def test_simhash_equals_brute_force(spark):
    rows = odd_docs()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    n = len(rows)
    root = groups(n, [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    members = {k: least([rows[i][0] for i in range(n) if root[i] == k]) for k in set(root)}
    want = Counter((rows[i][0], f"{fps[i]:016x}", members[root[i]]) for i in range(n))
    got = simhash.simhash_near_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_near_dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("tile", [5, 4096])
def test_near_links_in_split_buckets(spark, tile):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(50)}
    for x in list(fps)[:20]:  # crowded buckets
        y = x
        for _ in range(20):
            y ^= 1 << r.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile).collect()
    at = {f: i for i, f in enumerate(signed)}
    n = len(fps)
    want = groups(n, [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert groups(n, [(at[x.src], at[x.dst]) for x in links]) == want
    assert all((fps[at[x.src]] ^ fps[at[x.dst]]).bit_count() <= 64 for x in links)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)], [(1, 2), (2, 1), (1, 2), (5, 4)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    want = groups(max(map(max, edges), default=0) + 1, edges)
    assert set(got) == set(nodes)
    for a in nodes:
        for b in nodes[:5]:
            assert (got[a] == got[b]) == (want[a] == want[b])


def plain_cosine(a, b):
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("tile", [3, 2048])
def test_embeddings_equal_brute_force(spark, tile):
    r = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        centres = r.normal(size=(4, 12))
        rows += [(label, (centres[i % 4] + r.normal(size=12) * r.choice([0.02, 0.15, 1])).astype(np.float32).tolist()) for i in range(40)]
    rows += [(0, rows[0][1])] * 5 + [(1, [2 * x for x in rows[41][1]]), (0, [0.0] * 12), (0, None), (0, []), (0, [float("nan")] * 12), (1, [float("inf")] + [1.0] * 11), (0, [1.0] * 5), (0, [1.0] * 5), (1, [None] * 12), (0, [1e-30] * 12), (1, [1e30] * 12)]
    rows = [(i, e, lab, "clash", "clash") for i, (lab, e) in enumerate(rows)]
    rows += [rows[3], (None, rows[3][1], rows[3][2], "", "")]
    n = len(rows)
    ok = [x[2] is not None and bool(x[1]) and None not in x[1] and np.isfinite(x[1]).all() and any(x[1]) for x in rows]
    link = [(a, b) for a in range(n) for b in range(a) if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and plain_cosine(rows[a][1], rows[b][1]) >= 0.93]
    root, count = groups(n, link), Counter(x for e in link for x in e)
    want = Counter((rows[i][0], count[i], least([rows[j][0] for j in range(n) if root[j] == root[i]])) for i in range(n))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls string, grp string")
    got = embeddings.embedding_near_dedup(df, tile=tile).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == want
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert embeddings.embedding_near_dedup(df.limit(0)).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(text, items):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        w = plain_words(item)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[i : i + size]:
                    hit |= set(range(p, p + size))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("set_words", [20, 1_000_000])
def test_decontamination_equals_brute_force(spark, set_words):
    r = random.Random(2)
    w = ["ab", "Cd", "é", "12", "x"]
    items = [(i, " ".join(r.choice(w) for _ in range(r.randrange(0, 16)))) for i in range(12)] + [(50, None), (51, "..."), (52, "only-three: words"), (3, "x x")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, "ONLY three words"), (None, items[0][1])]
    docs += [(10 + i, ", ".join(r.choice(w) for _ in range(r.randrange(60))) + " " + (items[i % 12][1] if i % 3 else "")) for i in range(40)]
    docs += [docs[-1], (99, ("zq " * 30_000) + items[1][1])]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, hits string, n_words int")
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, row int")
    got = decontaminate.decontamination_report(df, bench, set_words=set_words).collect()
    want = Counter((i, *plain_report(t, items)) for i, t in docs)
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == want
    assert decontaminate.decontamination_report(df.limit(0), bench).count() == 0
    assert not any(x.contaminated for x in decontaminate.decontamination_report(df, bench.limit(0)).collect())
    clean = decontaminate.decontaminate(df, bench, set_words=set_words).collect()
    assert len(clean) == len(docs)
    gone = decontaminate.decontaminate(df, bench, remove="documents", set_words=set_words).collect()
    assert len(gone) == sum(not plain_report(t, items)[4] for _, t in docs)


def test_cut_words():
    assert decontaminate.cut_words("Keep, this gone now. Kept", [(2, 4)]) == "Keep, this . Kept"
    assert decontaminate.merged([(5, 7), (1, 3), (2, 4), (4, 5)]) == [(1, 7)]


def check_bins(rows, limits):
    bins = {}
    for x in rows:
        bins.setdefault(x.sequence_id, []).append(x)
    for own in bins.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= limits.tokens and len(own) <= limits.documents and sum(x.length**2 for x in own) <= limits.cost
    return bins


def test_packing_is_whole_and_gapless(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = [None, "", "a", "<|endoftext|> inside", "é" * 5000, "word " * 4000] + [" ".join("abcdefg"[: r.randrange(1, 7)] for _ in range(r.randrange(1, 900))) for _ in range(60)]
    docs = [(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "none", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length int")
    rows = packing.pack(df, keep_ids=True).collect()
    want = Counter()
    for i, t, _ in docs:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == want
    bins = check_bins(rows, packing.Limits())
    total = sum(x.length for x in rows)
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("choose", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 100, 10_000), (100, 3, 10_000), (100, 50, 4_000)])
def test_plan_holds_every_capacity(limits, choose):
    r = random.Random(6)
    lim = packing.Limits(*limits, choose=choose)
    counts = Counter(min(63, int(r.expovariate(0.05)) + 1) for _ in range(2000))
    slots = packing.plan(counts, lim)
    bins, seen = {}, Counter()
    for length, lo, hi, first, offset in slots:
        assert lo == seen[length]
        seen[length] = hi
        for k in range(lo, hi):
            bins.setdefault(first + k - lo, []).append((offset, length))
    assert seen == counts
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= lim.tokens and len(own) <= lim.documents and sum(n * n for _, n in own) <= lim.cost
    bound = max(sum(k * v for k, v in counts.items()) / lim.tokens, sum(counts.values()) / lim.documents, sum(k * k * v for k, v in counts.items()) / lim.cost)
    assert len(bins) <= 1.25 * bound + 1
