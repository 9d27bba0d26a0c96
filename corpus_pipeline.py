"""A corpus pipeline of the operators: five stages over the ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import collect_garbage, components, materialize, table
from terrafold.llm.copies import near_copies
from terrafold.llm.decontaminate import scan_benchmark
from terrafold.llm.languages import UNIT, UNKNOWN, fit, held_out, identify
from terrafold.llm.packing import pack
from terrafold.llm.pii import find_pii
from terrafold.llm.simhash import simhash_near_dedup

#: A document's largest language has this share of it; one that falls short with 95 % confidence is rejected.
LEAST_SHARE, CONFIDENCE = 0.5, 1.96
#: Rows that go, 8 bytes each, up to which their numbers are broadcast; beyond it the rows are joined by a shuffle.
MOST_SENT = 1_000_000


def fresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, begun with the executors' garbage collected, so that it doesn't add its memory to what the stages before it took."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


def by_row(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` written with a key of its own for each row, ``_key``, ordered as the ids are, null ids last."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    return materialize(docs.withColumn("_key", key), "rows")


@fresh
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language: text without letters goes, and a mixture that surely has no main language.

    The share is estimated from the text's units, so a short text's may fall short by chance; only a
    share whose upper confidence limit is below ``LEAST_SHARE`` rejects.
    """
    found = identify(docs, fit(docs.where(~held_out())), tuple(docs.columns))
    units = F.greatest(F.lit(1.0), F.length("text") / F.lit(UNIT))
    upper = F.col("score") + CONFIDENCE * F.sqrt(F.col("score") * (1 - F.col("score")) / units)
    return found.where((F.col("lang_pred") != UNKNOWN) & (upper >= LEAST_SHARE)).select(*docs.columns)


@fresh
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id.

    Texts link where their fingerprints differ in three bits or fewer (operator 10), and where their five-word similarity is 0.8 or
    more, which three bits don't reach; a group is what links of either kind join. Null and blank texts are copies of one another; a
    null id comes after all others; of repeated rows one stays; an empty table gives none.
    """
    keyed = by_row(docs)
    moved = []
    for f in (simhash_near_dedup, near_copies):
        moved.append(f(keyed, id_col="_key").where("not kept").select("_key", "component_id"))
        collect_garbage(spark)
    links = materialize(moved[0].union(moved[1]), "links")  # fewer rows than stay, and no text: the texts needn't move to be parted from them
    groups = materialize(components(links.select(F.col("_key.row").alias("src"), F.col("component_id.row").alias("dst"))), "groups")
    keys = links.select("_key").union(links.select("component_id")).distinct().join(groups, F.col("_key.row") == F.col("node"))
    least = keys.groupBy("root").agg(F.min("_key").alias("least"))
    gone = materialize(keys.join(least, "root").where("_key <> least").select(F.col("_key.row").alias("_row")), "gone")
    gone = gone.hint("broadcast" if gone.count() <= MOST_SENT else "merge")
    return keyed.join(gone, F.col("_key.row") == F.col("_row"), "left_anti").select(*docs.columns)


@fresh
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, also of one without an id; null, blank and repeated rows stay."""
    marked = scan_benchmark(docs.select(F.struct(*docs.columns).alias("d"), "text"), table(spark, sf_dir, "benchmark"), id_col="d")
    return marked.where("size(hits) = 0").select("id.*")


@fresh
def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = find_pii(docs.select(F.struct(*rest).alias("d"), "text"), id_col="d")
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns))


@fresh
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the training sequences; a null or empty text is one piece, repeated rows a set each."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("packing", packed),
]

#: Mixture inference, fingerprints and tokens have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
