"""Secrets, PII, languages, chats, URLs, licenses and the pipeline against plain versions."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrafold.llm import chat, languages, licenses, pii, queries, secrets, urls

SF = "/root/testdata/sf0.001"


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


# --- personal data ---------------------------------------------------------------------------------------------------


def plain_pii(text):
    def ip(m):
        return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.split("."))

    def card(m):
        d = [int(c) for c in m if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ip),
        ("card", r"[0-9]([\x20-]?[0-9])+", card),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


PII_TEXT = st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", " ", "+", "(", ")", "1", "25", "256", "4111111111111111", "0", "x1", "é", "10.0.0.1", "me@a.co", "+1 (212) 555-0101", "%", "\n"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(PII_TEXT)
def test_base_pii_spans_equal_the_patterns(text):
    got = [(k, a, b) for k, own in pii.base_spans(text).items() for a, b in own]
    assert got == plain_pii(text)


def test_pii_report(spark):
    mail = "write to ana.lee7@mail.example.com now"
    rows = [(1, None), (2, ""), (3, mail + ". later ana.lee7 again"), (4, "card 4111 1111 1111 1111 and é 10.2.3.4"), (4, "card 4111 1111 1111 1111 and é 10.2.3.4"), (None, "+1 (212) 555-0101; then 555-0101 alone"), (5, "9" * 4000), (6, "@" * 500 + "x" * 4000), (7, "12 apples in 1999, b2 and x-5 sold"), (8, "a1@ " * 9000)]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, n_email int, spans string")
    got = pii.find_pii(df).collect()
    want = Counter((i, *(Counter(k for k, *_ in plain_pii(t))[k] for k in pii.KINDS), digest(plain_pii(t))) for i, t in rows)
    assert Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got) == want
    by = {x.doc_id: x for x in got}
    assert "linked:" in by[3].spans and "ana.lee7" not in by[3].clean
    assert "linked:" in by[None].spans and "555-0101" not in by[None].clean
    assert by[7].n_linked == 0 and by[7].clean == rows[8][1] and by[1].clean is None and by[2].clean == ""
    assert pii.find_pii(df.limit(0)).count() == 0


def brute_field(text):
    """Marginal labels of the field by enumeration, small texts only."""
    import itertools
    import math

    base = pii.base_spans(text)
    taken = [s for own in base.values() for s in own]
    toks = [m.span() for m in pii.CANDIDATE.finditer(text)]
    clamp = [any(a < d and c < b for c, d in taken) for a, b in toks]
    own = [pii.CLAMP if f else pii.evidence(text[a:b], text[max(0, a - 40) : a].split()[-2:]) for (a, b), f in zip(toks, clamp)]
    hubs = {}
    for n, (a, b) in enumerate(toks):
        for k in pii.similar(text[a:b]):
            hubs.setdefault(k, []).append(n)
    odds = [[0.0, 0.0] for _ in toks]
    groups = [g for g in hubs.values() if len(g) > 1]
    for ys in itertools.product((0, 1), repeat=len(toks)):
        for hs in itertools.product((0, 1), repeat=len(groups)):
            s = sum(o for o, y in zip(own, ys) if y) + sum(pii.CHAIN for n in range(len(toks) - 1) if toks[n][1] + 1 >= toks[n + 1][0] and ys[n] == ys[n + 1])
            s += sum(pii.SKIP for g, h in zip(groups, hs) for n in g if ys[n] == h)
            for n, y in enumerate(ys):
                odds[n][y] += math.exp(s)
    return [n for n, (o, p) in enumerate(odds) if p > o and not clamp[n]], toks


@pytest.mark.parametrize("text", ["me.x9@a.co met me.x9 twice me.x9", "+1 (212) 555-0101 or 555-0101", "a b2 c3", "id 123456789 user z-91", "10.0.0.1 10.0.0.1, 10.0.0.1!", "b2 b2 b2 b2"])
def test_message_passing_agrees_with_enumeration(text):
    want, toks = brute_field(text)
    got = pii.linked_spans(text, pii.base_spans(text))
    assert [n for n, (a, b) in enumerate(toks) if any(a <= c and d <= b for c, d in got)] == want


# --- secrets ---------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    rules = [
        (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), i, m.end()) for i, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]
    return [(secrets.KINDS[i], a, b) for a, i, b in sorted(found)]


SECRET_TEXT = st.lists(st.sampled_from(["token", "SECRET", "Api_Key", "apikey", "password", "paſſword", "=", ": ", '"', "'", " ", "abcdefgh", "a1b2c3d4e5f60718", "AKIA", "AKIAABCDEFGH1234", "Z9", "_", "é", "\n"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(SECRET_TEXT)
def test_base_secret_spans_equal_the_patterns(text):
    assert [(k, a, b) for a, b, k, _ in secrets.base_spans(text)] == plain_secrets(text)


def test_ownership(spark):
    own, shared = "Zx81kQpL3vTn77RsWq20", "Qm4nT8vLz19XkP2sRb6y"
    rows = [(1, None, "a"), (2, "", "a"), (3, f"see {own} here", "a"), (3, f"see {own} here", "a"), (4, f"x {shared}", "a"), (5, f"x {shared}", "b"), (6, f"x {shared}", "c"), (None, 'token = "aaaaaaaa1"', None), (8, "deadbeef" * 8, "b"), (9, "q" * 100_000, "c")]
    df = spark.createDataFrame([(i, t, s, "c", 1) for i, t, s in rows], "doc_id long, text string, source string, hash string, row int")
    got = secrets.secret_report(df).collect()
    count = lambda t: Counter(k for k, *_ in plain_secrets(t))
    want = Counter((i, *(count(t)[k] for k in secrets.KINDS), digest(plain_secrets(t))) for i, t, _ in rows)
    assert Counter((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in got) == want
    by = {x.doc_id: x for x in got}
    assert by[3].n_owned == 1 and by[3].n_live == 1 and by[3].spans == "owned:4:24"
    assert by[4].n_owned == by[5].n_owned == 0
    assert by[None].n_unclear == 1 and by[9].spans == ""
    assert secrets.secret_report(df.limit(0)).count() == 0


# --- languages -------------------------------------------------------------------------------------------------------


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op4_languages(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in got if x.held_out]
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.lang_pred == x.lang for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got)


def test_language_mixtures_and_odd_rows(spark):
    r = random.Random(1)
    words = {"aa": ["kato", "moka", "tiko"], "bb": ["wurz", "schlu", "zwerg"], "cc": ["ilo", "elai", "aolie"]}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(i, say(x, 80), x) for i, x in enumerate("aa bb cc".split() * 12)]
    odd = [(100, None, "aa"), (101, "", "aa"), (102, "123 !", None), (103, say("aa", 300) + " " + say("bb", 100), None), (104, say("cc", 40_000), None), (None, say("bb", 5), "bb"), (1, rows[1][1], "bb")]
    df = spark.createDataFrame([(*x, 9, "") for x in rows + odd], "doc_id long, text string, lang string, k0 int, score string")
    got = languages.language_report(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[103].lang_pred == "aa" and 0.65 < by[103].mixture["aa"] < 0.85 and by[103].mixture["cc"] == 0
    assert by[104].lang_pred == "cc" and by[None].lang_pred == "bb"
    assert all(by[i].lang_pred == x for i, _, x in rows)
    assert languages.language_report(df.limit(0)).count() == 0
    assert {x.lang_pred for x in languages.language_report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- chats -----------------------------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    nasty = ["", None, "plain", "\\### Assistant: </turn> ok", "</turn>", "### user: x</turn>\n", "\\h\\l\\s\\c", "a\\", "ends with <", "</tur", "n>", "### ", "\n\n", "é😀 </turn>", "x" * 30_000, "</turn>\n" * 500]
    r = random.Random(8)
    rows = [(c, k, r.choice(["user", "assistant", "system", "a: b", "### x", None]), r.choice(nasty)) for c in range(30) for k in range(r.randrange(1, 9))]
    rows += [(900, None, "user", "x"), (900, 1, "assistant", "b"), (900, 1, "assistant", "a"), (900, 1, "assistant", "a"), (None, 0, "assistant", "lost"), (7, 0, "user", "tie")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat.chat_report(df).collect()}
    convs = {}
    for c, k, role, text in rows:
        convs.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert set(got) == set(convs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        turns.sort()
        learnt = "".join(x for *_, role, x in turns if role == "assistant")
        want = (len(turns), sha("".join(f"{role}\n{x}\n" for *_, role, x in turns)), len(learnt), sha(learnt), True)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].identical) == want
    assert chat.chat_report(df.limit(0)).count() == 0
    levels = {x.conv_id: x.escape_level for x in queries.op3_chat(spark, SF).collect()}
    assert levels[-7] == 1 and set(levels.values()) <= {0, 1}


# --- URLs ------------------------------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(r), v, r) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    given_ = [None, "", "no scheme", "http://", "http://NET/", "http://a.NET/x", "http://net", "http://inet/x", "http://Example.net/en/1", "http://x.example.net/en", "http://x.example.net/en/?q", "https://a.example.com/de/1#f", "http://example.com/de", "ftp://é.ORG/fr/x", "http://a.org?x=/fr/", "a://b://c/d", "http://h/" + "s/" * 5000, "http://q.org/fr/\n/x"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(given_)] + [(3, given_[3], "x", "y"), (None, "http://net/", "x", "y")], "page_id long, url string, host string, n string")
    got = urls.filter_urls(df).collect()
    assert len(got) == len(given_) + 2
    for x in got:
        url = "http://net/" if x.page_id is None else given_[x.page_id]
        verdict, rule = plain_rule(*plain_url(url))
        assert ((x.host, x.path), x.rule) == (plain_url(url), rule)
        assert x.verdict == (verdict or "allow")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_template_tree(spark):
    pages = [(i, f"http://h.test/shop/item{i}/view") for i in range(30)] + [(100 + i, f"http://h.test/blog/{i}") for i in range(30)] + [(200 + i, f"http://h.test/{c}/p{i}") for i, c in enumerate("abcdefghijklmnop")]
    bad = spark.createDataFrame([(i, i < 100) for i in [*range(20), *range(100, 120)]], "page_id long, bad boolean")
    got = {x.page_id: x for x in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels=bad).collect()}
    assert {got[i].verdict for i in range(30)} == {"block"} and {got[i].verdict for i in range(100, 130)} == {"allow"}
    assert len({got[i].template for i in range(30)}) == 1 and len({got[i].template for i in range(200, 216)}) == 1


# --- licenses --------------------------------------------------------------------------------------------------------


def plain_licenses(text):
    words, out = licenses.norm_words(text or ""), {}
    for name, template in licenses.TEMPLATES.items():
        tw = licenses.norm_words(template)
        want, size = licenses.shingles(tw), licenses.scale(len(tw))
        length, stride = size + licenses.step(size), licenses.step(size)
        best = max((len(licenses.shingles(words[a : a + length]) & want) / len(want) for a in range(0, len(words), stride)), default=0)
        if best >= 0.8:
            out[name] = round(best, 6)
    return out


def test_licenses(spark):
    r = random.Random(3)
    noise = lambda n: " ".join(r.choice(["foo", "Bar", "this", "under", "é", "9"]) for _ in range(n))
    texts = [None, "", "short", noise(400), "license " * 3000]
    for t in licenses.TEMPLATES.values():
        w = t.split()
        k = r.randrange(len(w))
        texts += [t, f"{noise(50)} {t} {noise(70)}", " ".join([*w[:k], "CHANGED", *w[k + 1 :]]), t.upper(), " ".join(w[: len(w) // 2])]
    texts.append(" ".join(licenses.TEMPLATES.values()) + noise(20_000))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(0, None, "x", 0), (None, texts[5], "x", 0)], "doc_id long, text string, words string, hits int")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        want = plain_licenses(texts[5] if x.doc_id is None else texts[x.doc_id])
        assert {y.name: round(y.containment, 6) for y in x.licenses} == want, x.doc_id
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_anchors_lose_nothing():
    marks = licenses.anchors()
    for text in licenses.TEMPLATES.values():
        every = licenses.shingles(licenses.norm_words(text))
        free = [s for s in every if not set(s.split()) & set(marks)]
        assert len(free) < 0.8 * len(every)
        assert licenses.least_collision(len(licenses.norm_words(text))) > 0.999


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    from tests.llm.test_search import groups, plain_fingerprint, plain_report

    real = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 !!", None, None, None), (9003, "", "en", "s", 0), (None, "the and of with this", "en", "s", 20)], real.schema)
    docs = real.unionByName(extra).unionByName(real.where("doc_id = 3"))
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs.write.parquet(path := str(tmp_path / f"{k}"))
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        docs = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == real.columns
    out = docs.collect()
    ids = lambda rows: Counter(x.doc_id for x in rows)
    assert not {9001, 9002, 9003} & set(ids(kept["near_dedup"]))
    assert ids(kept["language_id"])[3] == 2 and len(kept["near_dedup"]) == len(kept["language_id"]) - 3
    rows = kept["near_dedup"]
    fps = [plain_fingerprint(x.text) for x in rows]
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for x, g in zip(rows, root):
        least[g] = min(least.get(g, (True, 0)), (x.doc_id is None, x.doc_id or 0))
    assert ids(kept["decontamination"]) == Counter(None if none else i for none, i in least.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(kept["pii"]) == ids(x for x in kept["decontamination"] if not plain_report(x.text, items)[4])
    assert ids(kept["packing"]) == ids(kept["pii"])
    assert all(not plain_pii(x.text) and x.n_chars == len(x.text) for x in kept["packing"])
    assert {x.doc_id for x in out} == {x.doc_id for x in kept["packing"]}


def test_the_library_does_not_import_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "terrafold")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "terrafold.llm" not in open(os.path.join(folder, n)).read()
