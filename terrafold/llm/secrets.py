"""Secret scans: patterns, then corpus-wide ownership frequency of the candidates' hashes."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import chunks, materialize, texts

KINDS = ("assign", "access", "hex")
#: The kind of the spans that ownership adds: high-entropy tokens outside the patterns, seen at one owner only.
OWNED = "owned"

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run that is long enough is matched from its start; shorter runs hold no match that counts.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
OTHER = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
MIN_VALUE = 8
#: Bits a character, and classes among lower, upper and digit, that a live-looking value has at least.
MIN_ENTROPY = 3.0
MIN_CLASSES = 2
#: Owners from which on a value is a widely copied example.
EXAMPLE_OWNERS = 3

SPAN = "array<struct<kind:string,start:long,stop:long,hash:string,live:boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string()), ("live", pa.bool_())]))


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of the patterns, by start, then kind as listed; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2, m[0]) for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k], v) for a, b, k, v in out]


def live_looking(value: str) -> bool:
    """Random enough to be a credential: bits a character, and classes of characters."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return bits >= MIN_ENTROPY and classes >= MIN_CLASSES


def candidates(text: str) -> tuple[list, str]:
    """All candidates of a text, the patterns' first, and the digest of the patterns' spans."""
    base = base_spans(text)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, _ in base).encode()).hexdigest()
    free = [m for m in OTHER.finditer(text) if live_looking(m[0]) and not any(a < m.end() and m.start() < b for a, b, _, _ in base)]
    every = [*base, *((*m.span(), OWNED, m[0]) for m in free)]
    key = lambda v: hashlib.blake2b(v.encode(), digest_size=16).hexdigest()
    return [{"kind": k, "start": a, "stop": b, "hash": key(v), "live": live_looking(v)} for a, b, k, v in every], digest


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        spans, digests = zip(*map(candidates, texts(batch)))
        keep = [batch.column(c) for c in ("row", "id", "repo", "owner")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(spans, SPAN_TYPE), pa.array(digests)], ["row", "id", "repo", "owner", "spans", "base_sha256"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | str = "source", owner: Column | str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Secrets per row: ``(id_col, spans, base_sha256)``; each span with its value's ownership verdict.

    A span is ``(kind, start, stop, hash, verdict, repos, owners)``. Verdicts: ``example`` where the
    value's hash is at ``example_owners`` owners or more, ``live`` where it is at one owner and looks
    random, else ``unclear``. Patterns' spans stay whatever the verdict; high-entropy tokens outside
    them are added, as kind ``owned``, only where ``live``.

    Texts are read once; only candidates move. They are reduced to distinct (hash, repo, owner) before
    each shuffle, so a value that a third of all rows copy costs a row a task. The verdicts come
    back to the spans by a join on hash alone, whose hot hashes Spark splits, then by row.
    Cases: a null text has no spans; null repositories and owners count as one unnamed each; repeated rows
    are judged one by one but count as one owner; null ids stay; empty tables give empty results; other columns are ignored.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(as_col(repo).cast("string"), F.lit("")).alias("repo"), F.coalesce(as_col(owner).cast("string"), F.lit("")).alias("owner"), F.col(text_col).alias("text")
    )
    id_type = plain.schema["id"].dataType.simpleString()
    found = plain.mapInArrow(_scan, f"row long, id {id_type}, repo string, owner string, spans {SPAN}, base_sha256 string")
    found = materialize(found, "candidates")
    each = found.where("size(spans) > 0").select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    owners = each.groupBy("hash", "owner", "repo").agg(F.max("live").alias("live")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("live").alias("live"))
    owners = owners.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.max("live").alias("live"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("unclear")
    known = owners.select("hash", verdict.alias("verdict"), "repos", "owners")
    known = materialize(known, "owners")  # a plain table, so that Spark can split a hot hash's rows in the join
    judged = materialize(each.drop("repo", "owner", "live").join(known, "hash"), "judged")
    judged = judged.where(f"kind <> '{OWNED}' or verdict = 'live'")
    order = F.array_position(F.array(*map(F.lit, (*KINDS, OWNED))), F.col("kind"))
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "stop", "hash", "verdict", "repos", "owners"))).alias("s"))
    out = found.select("row", "id", "base_sha256").join(by_row, "row", "left")
    fields = lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "stop", "hash", "verdict", "repos", "owners")))
    spans = F.coalesce(F.transform("s", fields), F.array().cast("array<struct<kind:string,start:long,stop:long,hash:string,verdict:string,repos:long,owners:long>>"))
    return out.select(F.col("id").alias(id_col), spans.alias("spans"), "base_sha256")


def secret_report(docs: DataFrame, **kw) -> DataFrame:
    """The digest of :func:`scan_secrets`: counts by kind and verdict, spans as text."""
    found = scan_secrets(docs, **kw)
    number = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    return found.select(
        "doc_id",
        *(number("kind", k).alias(f"n_{k}") for k in (*KINDS, OWNED)),
        "base_sha256",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",").alias("spans"),
        *(number("verdict", v).alias(f"n_{v}") for v in ("example", "live", "unclear")),
    )
