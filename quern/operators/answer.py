"""Answers from retrieved chunks: context packing, extraction, citation checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.sentences import sentence_spans
from quern.functions.text import Analyzer, embedding_text, snippet

NO_CHUNKS = "retrieval returned no chunks"
UNRESOLVED = "no citation resolved to a retrieved chunk"
EMPTY = "model returned an empty answer"


def packed(ranked: DataFrame, max_chars: int = 6000, max_chunk_chars: int = 1500, text: str = "text") -> DataFrame:
    """ranked(qid, rank, text, heading, ...) cut to the blocks that fit: a prefix by rank, the first always.

    A block is its marker and the heading, if there is one, with the text, cut to ``max_chunk_chars``.
    """
    heading = F.col("heading") if "heading" in ranked.columns else F.lit("")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring(embedding_text(heading, F.col(text)), 1, max_chunk_chars))
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(run))
    return sized.where((F.col("used") <= max_chars) | (F.col("rank") == 1))


def context(packs: DataFrame) -> DataFrame:
    """(qid, context): blocks by rank, joined by blank lines."""
    parts = packs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return parts.select("qid", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def sentences(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with a row per sentence: i and sentence, white space collapsed."""

    def cut(column: pd.Series) -> pd.Series:
        return pd.Series([[" ".join(t[a:b].split()) for a, b in sentence_spans(t)] for t in column], dtype=object)

    return rows.select("*", F.posexplode(F.pandas_udf(cut, "array<string>")(F.col(text))).alias("i", "sentence"))


def supported(packs: DataFrame, questions: DataFrame, least: int = 20, analyzer: Analyzer | None = None) -> DataFrame:
    """(qid, rank, i, sentence, overlap): sentences of ``least`` characters or more with the share of the question's terms that they have, over 0."""
    analyzer = Analyzer() if analyzer is None else analyzer
    asked = questions.select("qid", F.array_distinct(analyzer.terms(F.col("question"))).alias("q")).where(F.size("q") > 0)
    rows = sentences(packs.select("qid", "rank", "text")).where(F.length("sentence") >= least).select("qid", "rank", "i", "sentence", analyzer.terms(F.col("sentence")).alias("t"))
    rows = rows.join(asked, "qid").withColumn("overlap", F.size(F.array_intersect("q", "t")) / F.size("q"))
    return rows.where("overlap > 0").select("qid", "rank", "i", "sentence", "overlap")


def extractive(packs: DataFrame, questions: DataFrame, max_sentences: int = 3, min_support: float = 0.0, least: int = 20, analyzer: Analyzer | None = None) -> DataFrame:
    """(qid, text, claimed): the sentences that share most question terms, each with its marker; no row without one."""
    rows = supported(packs, questions, least, analyzer).where(F.col("overlap") >= min_support)
    order = Window.partitionBy("qid").orderBy(F.col("overlap").desc(), "rank", "i")
    best = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_sentences)
    parts = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "sentence", "rank"))).alias("p"))
    line = F.transform("p", lambda x: F.concat(x["sentence"], F.lit(" ["), x["rank"].cast("string"), F.lit("]")))
    return parts.select("qid", F.array_join(line, " ").alias("text"), F.transform("p", lambda x: x["rank"]).alias("claimed"))


def refusals(packs: DataFrame, questions: DataFrame, thresholds: list[float], analyzer: Analyzer | None = None) -> DataFrame:
    """(min_support, refused): the share of questions without a sentence of that support, all thresholds in one pass."""
    best = supported(packs, questions, analyzer=analyzer).groupBy("qid").agg(F.max("overlap").alias("best"))
    rows = questions.select("qid").join(best, "qid", "left").withColumn("min_support", F.explode(F.array(*map(F.lit, thresholds))))
    return rows.groupBy("min_support").agg(F.avg(F.when(F.col("best") >= F.col("min_support"), 0.0).otherwise(1.0)).alias("refused"))


def _strip(texts: pd.Series, valid: pd.Series) -> pd.Series:
    out = []
    for text, keep in zip(texts, valid, strict=True):
        known = set(keep)
        text = re.sub(r"\[([0-9]{1,3})\]", lambda m: m[0] if int(m[1]) in known else "", text or "")
        out.append(re.sub(r"[ \t]+", " ", text).strip())
    return pd.Series(out, dtype=object)


def enforced(answers: DataFrame, packs: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(qid, text, citations, refused, reason) for every question from answers(qid, text, claimed).

    Markers are those claimed, then those in the text; unresolved ones go from both. Refuses
    without chunks, without a resolved citation, for a blank text, and where the answers have a
    column ``failure`` for what it says.
    """
    sources = packs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("marker"), F.col(key).alias(key), snippet(F.col("text"), 240).alias("quote")))).alias("sources"))
    rows = questions.select("qid").join(answers, "qid", "left").join(sources, "qid", "left")
    inline = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    claimed = F.coalesce(F.transform("claimed", lambda x: x.cast("int")), F.expr("cast(array() as array<int>)"))
    rows = rows.withColumn("sources", F.coalesce("sources", F.expr(f"cast(array() as {sources.schema['sources'].dataType.simpleString()})")))
    rows = rows.withColumn("markers", F.array_distinct(F.concat(claimed, F.array_sort(inline))))
    rows = rows.withColumn("valid", F.array_intersect("markers", F.transform("sources", lambda s: s["marker"])))
    rows = rows.withColumn("text", F.pandas_udf(_strip, "string")("text", "valid"))
    failure = F.col("failure") if "failure" in answers.columns else F.lit(None).cast("string")
    reason = F.when(F.size("sources") == 0, NO_CHUNKS).when(failure.isNotNull(), failure).when(F.size("valid") == 0, UNRESOLVED).when(F.regexp_replace("text", r"\[[0-9]+\]|\s", "") == "", EMPTY)
    rows = rows.withColumn("reason", reason).withColumn("refused", F.col("reason").isNotNull())
    cited = F.flatten(F.transform("valid", lambda m: F.filter("sources", lambda s: s["marker"] == m)))
    return rows.select("qid", F.when(F.col("refused"), "").otherwise(F.col("text")).alias("text"), F.when(F.col("refused"), F.slice("sources", 1, 0)).otherwise(cited).alias("citations"), "refused", "reason")
