"""The queries of the operators, over their whole tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.chat import chat_report
from terrafold.llm.common import table
from terrafold.llm.decontaminate import decontamination_report
from terrafold.llm.embeddings import embedding_near_dedup
from terrafold.llm.languages import language_report
from terrafold.llm.licenses import license_report
from terrafold.llm.oracles import DECONTAMINATION, EMBEDDINGS, chat_sql, url_sql
from terrafold.llm.packing import pack
from terrafold.llm.pii import find_pii
from terrafold.llm.secrets import secret_report
from terrafold.llm.simhash import simhash_near_dedup
from terrafold.llm.urls import filter_urls


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no repositories: a source's documents of one language stand for one, the source for its owner."""
    docs = table(spark, sf_dir, "documents")
    return secret_report(docs, repo=F.concat_ws("/", "source", "lang"), owner="source")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).withColumn("purity", F.round("purity", 9))


CONFLICT = "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONFLICT).alias("text"))
    return chat_report(rows.unionByName(more))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), keep_text=False)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_urls, op3_chat, op4_languages, op5_pii, op6_packing, op7_decontaminate, op8_licenses, op9_embeddings, op10_simhash)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: mixtures, message passing, XXH64 votes, tokens and MinHash; tests hold them against brute force."""
    return {"op2_urls": url_sql(), "op3_chat": chat_sql(CONFLICT), "op7_decontaminate": DECONTAMINATION, "op9_embeddings": EMBEDDINGS}
