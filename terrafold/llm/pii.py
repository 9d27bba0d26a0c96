"""PII: patterns, then a skip-chain conditional random field over each document's tokens."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_batches, chunks, texts

KINDS = ("email", "ip", "card", "phone")
#: The kind of the spans that the field adds.
LINKED = "linked"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A number's run of digits is taken from its start: no match can begin inside one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free and (m := DOMAIN.match(text, at + 1)):
            a = at
            while a > free and text[a - 1] in LOCAL:
                a -= 1
            if a < at:
                out.append((a, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The patterns' spans by kind, in code points, end exclusive; failing matches are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


# The field's log-potentials, fixed values. A token's own evidence for "personal" starts at BIAS.
BIAS = -6.0
LONG_NUMBER = 3.0  # six digits or more
MOSTLY_DIGITS = 1.0
HANDLE = 3.5  # letters and digits joined by . _ or -
ADDRESS = 3.5  # an @ inside
CUE = 1.3  # a cue word among the two tokens before
CLAMP = 12.0  # inside a pattern's span
CHAIN = 0.5  # two tokens side by side, same label
SKIP = 3.5  # two similar tokens of the document, same label
ROUNDS = 10
CUES = frozenset("email e-mail mail phone tel telephone call mobile contact card ip address user account id login".split())

#: Only tokens with a digit or an @ can be personal: without one the evidence is BIAS + CUE = -4.7, and what the
#: neighbours (2 * CHAIN = 1) and one similar token (below SKIP = 3.5) send can't lift that over 0.
CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGE = ".,;:!?()[]{}<>\"'#*$%&|=~`"
HANDLE_SHAPE = re.compile(r"[^\W\d_]+[._-][A-Za-z0-9._-]*\d|\d[A-Za-z0-9._-]*[._-][^\W\d_]+")


def message(h: float, coupling: float) -> float:
    """Log-odds that a neighbour of evidence ``h`` sends over an edge that favours equal labels."""
    return 2 * math.atanh(math.tanh(coupling / 2) * math.tanh(h / 2))


def similar(token: str) -> set[str]:
    """Keys under which tokens count as repeated or similar: the trimmed form, its digits if six or more, an address's local part."""
    core = token.strip(EDGE).lower()
    keys = {f"t:{core}"} if core else set()
    digits = "".join(DIGITS.findall(core))
    if len(digits) >= 6:
        keys.add(f"d:{digits}")
    if "@" in core and core[0] != "@":
        keys.add(f"t:{core.split('@')[0]}")
    return keys


def evidence(token: str, before: list[str]) -> float:
    core = token.strip(EDGE)
    digits = len(DIGITS.findall(core))
    return (
        BIAS
        + (LONG_NUMBER if digits >= 6 else 0)
        + (MOSTLY_DIGITS if 2 * digits > len(core) else 0)
        + (HANDLE if HANDLE_SHAPE.fullmatch(core) else 0)
        + (ADDRESS if "@" in core[1:-1] else 0)
        + (CUE if any(w.strip(EDGE).lower() in CUES for w in before) else 0)
    )


def linked_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Tokens outside the patterns' spans that the skip-chain field labels personal.

    Nodes are the tokens with a digit or an @. Chain edges join neighbours in the text, skip edges
    all tokens with a similar form, however far apart. Loopy belief propagation in log-odds runs over
    both; the tokens of one form talk through a hub, so a form with many tokens costs linear work.
    """
    tokens = [m.span() for m in CANDIDATE.finditer(text)]
    if not tokens:
        return []
    taken = sorted(s for spans in base.values() for s in spans)
    ends, reach, clamped, k = [], 0, [], 0
    for a, b in tokens:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        clamped.append(reach > a)
    words = [text[a:b] for a, b in tokens]
    own = [CLAMP if c else evidence(w, text[max(0, a - 40) : a].split()[-2:]) for (a, _), w, c in zip(tokens, words, clamped)]
    if max(own) <= 0:
        return []  # evidence against sends only more of it
    hubs = defaultdict(list)
    for n, word in enumerate(words):
        for key in similar(word):
            hubs[key].append(n)
    groups = [g for g in hubs.values() if len(g) > 1]
    near = [tokens[n][1] + 1 >= tokens[n + 1][0] for n in range(len(tokens) - 1)]
    # messages to a token: from its left, from its right, from each hub
    left, right = [0.0] * len(tokens), [0.0] * len(tokens)
    skip = [[0.0] * len(g) for g in groups]
    for _ in range(ROUNDS):
        belief = [o + x + y for o, x, y in zip(own, left, right)]
        for g, got in zip(groups, skip):
            for n, m in zip(g, got):
                belief[n] += m
        new_left, new_right = left[:], right[:]
        for n, joined in enumerate(near):
            if joined:
                new_left[n + 1] = message(belief[n] - right[n], CHAIN)
                new_right[n] = message(belief[n + 1] - left[n + 1], CHAIN)
        moved = max((abs(x - y) for x, y in zip(left + right, new_left + new_right)), default=0.0)
        for i, (g, got) in enumerate(zip(groups, skip)):
            sent = [message(belief[n] - m, SKIP) for n, m in zip(g, got)]
            total = sum(sent)
            new = [max(-SKIP, min(SKIP, message(total - s, SKIP))) for s in sent]
            moved = max(moved, max(abs(x - y) for x, y in zip(new, got)))
            skip[i] = new
        left, right = new_left, new_right
        if moved < 1e-3:
            break
    belief = [o + x + y for o, x, y in zip(own, left, right)]
    for g, got in zip(groups, skip):
        for n, m in zip(g, got):
            belief[n] += m
    out = []
    for (a, b), h, fixed in zip(tokens, belief, clamped):
        if h > 0 and not fixed:
            core = text[a:b].strip(EDGE)
            at = text.index(core, a)
            out.append((at, at + len(core)))
    return out


SHAPE = 2.0  # a token that looks like a kind


def shape(token: str) -> list[float]:
    """Log-potentials of a token's look for each of ``KINDS``."""
    core = token.strip(EDGE)
    digits, letters = len(DIGITS.findall(core)), any(c.isalpha() for c in core)
    looks = ("@" in core or HANDLE_SHAPE.fullmatch(core), re.fullmatch(r"[0-9]+(?:\.[0-9]+)+", core), digits >= 13, 6 <= digits < 13 and not letters)
    return [SHAPE if x else 0.0 for x in looks]


def _agreeing(log: list[float], coupling: float) -> list[float]:
    """Log-message over an edge that favours equal labels, largest entry 0."""
    top = max(log)
    weight = [math.exp(x - top) for x in log]
    total, more = sum(weight), math.expm1(coupling)
    out = [math.log(total + more * w) for w in weight]
    return [x - max(out) for x in out]


def linked_kinds(text: str, base: dict[str, list[tuple[int, int]]], added: list[tuple[int, int]]) -> list[str]:
    """The kind of each added span: the most probable label under a second field over the personal tokens.

    Labels are ``KINDS``. A token in a pattern's span is held to its kind, an added one has its look; the similar tokens of a form
    share potentials for equal labels through a hub, and loopy messages carry a kind from token to token, also through forms that two
    tokens share only by way of a third. Of equal labels the first of ``KINDS`` stands.
    """
    if not added:
        return []
    spans = sorted((a, b, k) for k, own in enumerate(base.values()) for a, b in own)
    nodes: list[tuple[str, list[float]]] = []
    for m in CANDIDATE.finditer(text):
        kind = next((k for a, b, k in spans if a < m.end() and m.start() < b), None)
        if kind is not None:
            nodes.append((m[0], [CLAMP if k == kind else 0.0 for k in range(len(KINDS))]))
    first = len(nodes)
    nodes += [(text[a:b], shape(text[a:b])) for a, b in added]
    hubs = defaultdict(list)
    for n, (token, _) in enumerate(nodes):
        for key in similar(token):
            hubs[key].append(n)
    groups = [g for g in hubs.values() if len(g) > 1]
    none = [0.0] * len(KINDS)
    got = [[none] * len(g) for g in groups]

    def beliefs() -> list[list[float]]:
        out = [own[:] for _, own in nodes]
        for g, messages in zip(groups, got):
            for n, message_ in zip(g, messages):
                out[n] = [x + y for x, y in zip(out[n], message_)]
        return out

    for _ in range(ROUNDS):
        now = beliefs()
        for i, g in enumerate(groups):
            sent = [_agreeing([x - y for x, y in zip(now[n], m)], SKIP) for n, m in zip(g, got[i])]
            total = [sum(x) for x in zip(*sent)]
            got[i] = [_agreeing([x - y for x, y in zip(total, s)], SKIP) for s in sent]
    return [KINDS[max(range(len(KINDS)), key=own.__getitem__)] for own in beliefs()[first:]]


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)


FOUND = [*(f"n_{k}" for k in KINDS), "n_linked", "base_sha256", "spans", "linked_kinds", "clean"]


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    flat = sorted((a, b, i, k) for i, (k, own) in enumerate(spans.items()) for a, b in own)
    for a, b, _, kind in flat:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for text, given in zip(texts(batch), batch.column("text").is_valid().to_pylist()):
                base = base_spans(text)
                added = linked_spans(text, base)
                kinds = linked_kinds(text, base, added)
                every = base | {LINKED: added}
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                marked = {k: sorted([*base[k], *(s for s, own in zip(added, kinds) if own == k)]) for k in KINDS} if added else base
                clean = (redact(text, marked) if any(every.values()) else text) if keep_text and given else None
                rows.append((*(len(base[k]) for k in KINDS), len(added), digest, _joined(every), ",".join(kinds), clean))
            cols = zip(FOUND, zip(*rows))
            arrays = [pa.array(c, pa.int64() if n[:2] == "n_" else pa.string()) for n, c in cols]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *arrays], ["id", *FOUND])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, n_linked, base_sha256, spans, linked_kinds, clean)`` per row.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by kind, then start, the spans that the field added last, as ``linked``;
    ``linked_kinds`` names the kind that each of those is, in their order; ``clean`` is the text with every span replaced by its kind (left
    out unless ``keep_text``). One pass, no shuffle.
    Cases: a null text has no spans and a null ``clean``; an empty one likewise, with an empty
    ``clean``; null ids and repeated rows stay as they are; equal spans of two kinds are listed under
    both; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = plain.schema["id"].dataType.simpleString()
    types = ", ".join(f"{n} {'long' if n[:2] == 'n_' else 'string'}" for n in FOUND)
    found = plain.mapInArrow(_scan(keep_text), f"id {id_type}, {types}").withColumnRenamed("id", id_col)
    return found if keep_text else found.drop("clean")
