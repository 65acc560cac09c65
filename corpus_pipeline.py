"""From raw documents to token ids: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import token_digests
from quern.llm.language import learned, predicted
from quern.llm.minhash import near_duplicates
from quern.llm.mixing import mixed
from quern.llm.secrets import redacted
from quern.llm.tables import documents, fresh, keep, small, told_apart


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, no letter); a null lang is filled with the prediction.

    Without a labelled document nothing can be predicted: a text with a letter stays, its lang null.
    """
    model = learned(docs.select(F.col("doc_id").cast("long").alias("key"), "text", "lang"))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = predicted(docs, model, names).where(F.col(names[0]) != "und")
    return found.withColumn("lang", F.coalesce("lang", names[0])).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id, null last, of each group at a similarity of 0.8; rows equal in doc_id and text are one."""
    rows = told_apart(docs)
    if rows is None:
        return _first_of_groups(docs)
    own = rows.columns[0]
    return _first_of_groups(rows).drop("doc_id").withColumnRenamed(own, "doc_id").select(*docs.columns)


def _first_of_groups(docs: DataFrame) -> DataFrame:
    gone = keep(near_duplicates(docs, percent=80), "groups").where("not kept").select("doc_id")
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret; no document goes."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of its source asks, none to three times; texts without words go."""
    return mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with a digest of what they decode to."""
    return token_digests(docs, with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Language profiles, automata and BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
