"""Language ID: mixtures of languages by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_batches, chunks, texts

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Labelled rows, about, that the n-gram model is fitted on. All their n-grams are kept; so many of them, by language, that the
#: driver and tasks could not hold the model are an error, never a smaller model.
FIT_ROWS = 20_000
FIT_GRAMS = 4_000_000
#: Trigrams that make up one unit of the mixture, a stretch of text in one language.
UNIT = 32
#: Rounds of expectation-maximisation for each set of languages.
ROUNDS = 12
#: Log-likelihood that one more language must gain: this times the logarithm of the number of units.
PENALTY = 4.0
SMOOTH = 0.5


def trigrams(text: str) -> np.ndarray:
    """Trigrams of a lower-cased text as numbers; every stretch of other characters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not len(points):
        return points
    plain = (points >= 97) & (points <= 122)
    wide = points >= 0xAA
    points = np.where(plain | wide, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = np.concatenate(([32], points[keep], [32]))
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, one row each for 2 MB of text: a trigram takes 8 bytes, and as many again while they are counted."""
    for batch in chunks(batches, most_bytes=2 << 20):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        own = texts(batch)
        for lang in sorted(set(langs)):
            grams, n = np.unique(np.concatenate([trigrams(own[i]) for i in np.flatnonzero(langs == lang)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


class Model:
    """Log-probabilities ``table[gram, language]``; the last row is for n-grams that it doesn't hold."""

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> None:
        order = np.argsort(grams)
        self.langs, self.grams = langs, grams[order]
        counts = np.vstack([counts[order], np.zeros((1, len(langs)))])
        if len(langs):
            counts[-1] = np.maximum(totals - counts.sum(0), 0) / max(1, len(grams))  # what is left out, spread thinly
        self.table = np.log((counts + SMOOTH) / (totals + SMOOTH * (len(grams) + 1)))

    def units(self, text: str) -> np.ndarray:
        """Log-likelihood of each unit of a text under each language."""
        grams = trigrams(text)
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        place[self.grams[place] != grams] = len(self.grams)
        return np.add.reduceat(self.table[place], np.arange(0, len(place), UNIT), axis=0)


def mixtures(units: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Language proportions of each document, whose units begin at ``begins``.

    For a set of languages, expectation-maximisation shares each unit among them and takes the shares'
    mean as the next proportions. The set shrinks from all languages: the one with the least
    proportion is left out where the rest explain the units as well but for the penalty. All
    documents of a batch go through each step together.
    """
    docs, langs = len(begins), units.shape[1]
    sizes = np.diff(np.concatenate((begins, [len(units)])))
    owner = np.repeat(np.arange(docs), sizes)
    top = units.max(1, keepdims=True)
    likely = np.exp(units - top)

    def fitted(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            joint = likely * share[owner]
            total = joint.sum(1, keepdims=True)
            joint /= np.maximum(total, 1e-300)
            share = np.add.reduceat(joint, begins, axis=0) / sizes[:, None]
        joint = (likely * share[owner]).sum(1)
        return share, np.add.reduceat(np.log(np.maximum(joint, 1e-300)), begins)

    allowed = np.ones((docs, langs))
    share, value = fitted(allowed)
    open_ = np.arange(docs)
    for _ in range(langs - 1):
        smaller = allowed.copy()
        smaller[open_, np.where(allowed > 0, share, np.inf)[open_].argmin(1)] = 0
        share2, value2 = fitted(smaller)
        better = np.zeros(docs, bool)
        better[open_] = value2[open_] + PENALTY * np.log(sizes[open_] + 1) >= value[open_]
        allowed[better], share[better], value[better] = smaller[better], share2[better], value2[better]
        open_ = np.flatnonzero(better)
        if not len(open_):
            break
    return share


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, grams: int = FIT_GRAMS, id_col: str = "doc_id") -> Model:
    """N-gram model of the labelled texts; rows without text or language are left out.

    About ``rows`` rows, chosen by a hash of the id and the text, are counted on the executors; the driver gets the counts, one number a
    language and n-gram, and refuses more than ``grams``.
    Exact copies under ids of their own are drawn one by one; a table without ``id_col`` is drawn by the text alone, copies together.
    """
    own = F.col(id_col) if id_col in labelled.columns else F.lit(None).cast("long")
    known = labelled.select(own.alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.lit(int((1 << 20) * rows / n)))
    counted = known.select("text", "lang").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.limit(grams + 1).toArrow()
    if found.num_rows > grams:
        raise ValueError(f"the fit sample has more than {grams} n-grams by language: fit on fewer rows, or raise grams")
    langs, lang = np.unique(np.array(found.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
    kept, place = np.unique(found.column("gram").to_numpy(), return_inverse=True)
    table = np.zeros((len(kept), len(langs)))
    table[place, lang] = found.column("n").to_numpy()
    return Model(langs.tolist(), kept, table, table.sum(0))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = [*model.langs, UNKNOWN]
        for batch in chunks(batches, most_bytes=2 << 20):
            own = texts(batch)
            known = [i for i, t in enumerate(own) if len(model.grams) and LETTER.search(t)]
            best, score = np.full(len(own), len(model.langs)), np.zeros(len(own))
            shares = np.zeros((len(own), len(model.langs)))
            if known:
                units = [model.units(own[i]) for i in known]
                begins = np.concatenate(([0], np.cumsum([len(u) for u in units])[:-1]))
                shares[known] = mixtures(np.concatenate(units), begins)
                best[known], score[known] = shares[known].argmax(1), np.clip(shares[known].max(1), 0, 1)
            mixes = pa.array([dict(zip(model.langs, s.tolist())) if b < len(model.langs) else {} for s, b in zip(shares, best)], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([names[b] for b in best]), pa.array(score), mixes], [*batch.schema.names[:-1], "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``(*keep, lang_pred, score, mixture)`` per row: the language with the largest proportion, the proportion, all of them.

    Cases: ``und`` and score 0 where the text is null or has no letter, or the model has seen no
    labelled text; ties go to the language that sorts first; null ids and repeated rows stay as they are; an
    empty table gives an empty result; other columns are ignored. Whole texts are read, in one pass and without a shuffle.
    """
    bounded_batches(docs)
    plain = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = plain.mapInArrow(_predict(shared), f"{types}, lang_pred string, score double, mixture map<string,double>")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from fitting: crc32 of the id as text is divisible by 5. A null id is kept from it too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_report(docs: DataFrame) -> DataFrame:
    """Fit on the rows that aren't held out, predict every row."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    return identify(marked, fit(marked.where(~F.col("held_out"))), ("doc_id", "held_out"))
