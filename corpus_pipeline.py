"""The corpus pipeline: from raw documents to packed training sequences, in stages that are written one by one.

Documents whose language cannot be told, having no letter, go, toxic ones go, of near duplicates one stays, personal data gets
surrogates, and what is left is packed. Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm import language, simhash, surrogates, toxicity
from watchmill.llm.common import materialize, table
from watchmill.llm.packing import pack_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and null ones, whose language is unknown; the model is learned from the rows at hand."""
    model = language.learn(docs.select("doc_id", "text", "lang"))
    judged = language.language_of(F.col("text"), model, spark)
    return docs.where(judged["lang_pred"] != language.UNKNOWN)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are more likely toxic than not; the model is learned from the labelled rows at hand."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.severity_of(F.col("text"), model, spark)
    return docs.where(~judged["toxic"])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays: that with the smallest id, rows without one last.

    Rows are told apart by a hash of id and text, so of rows that share an id only the near duplicates go. Of rows that agree
    in both, one stays.
    """
    key = F.xxhash64("doc_id", "text")
    found = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row_key")).distinct()
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key")).alias("smallest")
    chosen = materialize(found.join(ids, "row_key").groupBy("component_id").agg(smallest).select("smallest.row_key"), "chosen-rows")
    repeated = docs.groupBy(key.alias("row_key")).count().where("count > 1").select("row_key")
    repeated = materialize(repeated.join(chosen, "row_key", "left_semi"), "repeated-rows")
    once = chosen.join(repeated, "row_key", "left_anti")
    stay = docs.join(once, key == once["row_key"], "left_semi")
    one = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("one")
    return stay.unionByName(docs.join(repeated, key == repeated["row_key"], "left_semi").groupBy(key).agg(one).select("one.*"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the text."""
    replaced = surrogates.replace_entities(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced = replaced.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return replaced


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", in_a_language),
    ("toxicity", not_toxic),
    ("near-duplicates", one_of_each),
    ("personal-data", private),
    ("packing", packed),
]
#: Models, fingerprints and tokenizers cannot be said in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
