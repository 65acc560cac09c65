"""Fusion of ranked lists (qid, source, key, score, rank) and reranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import FusionError
from quern.functions.stem import remembered
from quern.functions.text import Analyzer
from quern.operators.search import DIGITS


def fuse(lists: DataFrame, key: str, k: int, method: str = "rrf", rrf_k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, key, score, ranks, rank): ``rrf`` adds w / (rrf_k + rank), ``weighted`` w * min-max score.

    An unknown source weighs 1. A list without spread counts 1 for all. Ties go to the smaller key.
    """
    weights = {"dense": 0.5, "lexical": 0.5} if weights is None else weights
    if method not in ("rrf", "weighted") or rrf_k <= 0 or any(w < 0 for w in weights.values()):
        raise FusionError(f"bad fusion options: {method}, {rrf_k}, {weights}")
    w = F.lit(1.0)
    for source, value in weights.items():
        w = F.when(F.col("source") == source, F.lit(float(value))).otherwise(w)
    if method == "rrf":
        part = w / (F.lit(rrf_k) + F.col("rank"))
    else:
        one = Window.partitionBy("qid", "source")
        low, high = F.min("score").over(one), F.max("score").over(one)
        part = w * F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    # rounded to whole units of 1e-12, so that the order of adding changes nothing
    parts = lists.withColumn("part", F.round(part * 1e12).cast("long"))
    summed = parts.groupBy("qid", key).agg((F.sum("part") / 1e12).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("ranks"))
    order = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), key)
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))


def explained(fused: DataFrame, key: str) -> Column:
    """``id rrf=0.01639 dense#1 lexical#4``, sources in order."""
    marks = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat(e["key"], F.lit("#"), e["value"].cast("string"))), " ")
    return F.concat_ws(" ", F.col(key).cast("string"), F.concat(F.lit("rrf="), F.format_string("%.5f", F.bround("score", 5))), marks)


def least_window(terms: list[str], wanted: set[str]) -> int:
    """Tokens in the smallest window of ``terms`` with one of each wanted term; 0 if one is missing."""
    last: dict[str, int] = {}
    best = 0
    for i, t in enumerate(terms):
        if t in wanted:
            last[t] = i
            if len(last) == len(wanted):
                width = i - min(last.values()) + 1
                best = width if not best else min(best, width)
    return best


def _closeness(terms: pd.Series, wanted: pd.Series, stemming: pd.Series) -> pd.DataFrame:
    rows = []
    for t, q, stems in zip(terms, wanted, stemming, strict=True):
        t = [remembered(x) for x in t] if stems else t
        found = set(q) & set(t)
        rows.append((len(found), sum(x in found for x in t), least_window(list(t), found) if found else 0))
    return pd.DataFrame(rows, columns=["matched", "hits", "width"], dtype="int64")


def rerank(candidates: DataFrame, questions: DataFrame, key: str, k: int, text: str = "text", coverage: float = 0.6, proximity: float = 0.25, density: float = 0.15, analyzer: Analyzer | None = None) -> DataFrame:
    """(qid, key, score, rank) of candidates(qid, key, text) by coverage, proximity and density of the question's terms.

    The least window is a sweep with state, hence an Arrow UDF; a native form would need a row
    for each hit and matched term. Candidates without a matched term score 0.
    """
    analyzer = Analyzer() if analyzer is None else analyzer
    asked = questions.select("qid", F.array_distinct(analyzer.terms(F.col("question"))).alias("q"))
    base = candidates.select("qid", key, analyzer.surface(F.col(text)).alias("t")).join(asked, "qid")
    base = base.withColumn("x", F.pandas_udf(_closeness, "matched long, hits long, width long")("t", "q", F.lit(analyzer.stemming)))
    x = lambda name: F.col("x").getField(name)
    score = coverage * x("matched") / F.size("q") + proximity * x("matched") / x("width") + density * F.least(F.lit(1.0), 10.0 * x("hits") / F.size("t"))
    scored = base.select("qid", key, F.when(x("matched") > 0, score).otherwise(0.0).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))


def judged(candidates: DataFrame, questions: DataFrame, key: str, k: int, judge, text: str = "text", cut: int = 1200) -> DataFrame:
    """Reranking by ``judge(question, text) -> 0..10``; a question with any failure falls back to ``rerank``."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        try:
            return pd.DataFrame({"qid": f["qid"], key: f[key], "score": [float(judge(q, t[:cut])) / 10 for q, t in zip(f["question"], f[text], strict=True)]})
        except Exception:  # the judge's own failures, of any kind, mean the fallback
            return pd.DataFrame({"qid": f["qid"], key: f[key], "score": None})

    kinds = dict(candidates.dtypes)
    said = candidates.join(questions, "qid").groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, {key} {kinds[key]}, score double")
    plain = rerank(candidates, questions, key, 1 << 30, text).select("qid", key, F.col("score").alias("plain"))
    scored = said.join(plain, ["qid", key]).select("qid", key, F.coalesce("score", "plain").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))
