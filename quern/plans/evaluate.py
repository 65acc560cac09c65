"""Evaluation: one row of metrics for a configuration, and sweeps over configurations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.stem import stemmed
from quern.functions.text import Analyzer
from quern.operators import chunk, metrics
from quern.plans.config import Config, variant
from quern.plans.pipeline import Pipeline
from quern.sources.tables import kept

#: Where recall is reported.
REPORT_K = (1, 3, 5)


def _mean(rows: DataFrame, column) -> float:
    return float(rows.agg(F.coalesce(F.avg(column), F.lit(0.0))).first()[0])


def grounding(said: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, faithful, answer_terms) of answers(qid, text, citations, refused), by the default analysis whatever the configuration."""
    analyzer = Analyzer()
    cited = said.select("qid", F.explode("citations.chunk_id").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    cited = cited.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(analyzer.surface(F.col("text"))))).alias("cited"))
    none = F.expr("cast(array() as array<string>)")
    rows = said.join(cited, "qid", "left").join(questions.select("qid", "answer"), "qid")
    own = analyzer.terms(metrics.without_markers(F.col("text")))
    rows = rows.select("qid", "refused", own.alias("own"), stemmed(F.coalesce("cited", none)).alias("cited"), analyzer.terms(F.coalesce("answer", F.lit(""))).alias("gold"))
    return rows.select("qid", metrics.faithfulness(F.col("refused"), F.col("own"), F.col("cited")).alias("faithful"), metrics.term_recall(F.col("gold"), F.col("own")).alias("answer_terms"))


def evaluate(spark: SparkSession, config: Config, docs: DataFrame, questions: DataFrame, unanswerable: DataFrame | None = None, run: str = "", retrieval: str = "hybrid", timed: int = 0, **services) -> dict:
    """A row of means over questions(qid, question, answer, doc_id, gold_start, gold_end) for one configuration.

    All questions go through in one batch, whose milliseconds a question are reported; the
    first ``timed`` of them by qid are also asked one by one for p50 and p95. An answer that
    cites what was not retrieved is an error.
    """
    with Pipeline(spark, config, **services) as p:
        report = p.index(docs)
        began, n = time.perf_counter(), questions.count()
        found = kept(p.retrieve(questions), "found")
        said = kept(p.answers(questions, found=found), "said")
        batch_ms = (time.perf_counter() - began) * 1000 / max(1, n)
        chunks = p.chunks
        gold = kept(metrics.relevant(chunks, questions), "gold")
        out: dict = {"run": run, "chunker": config.chunking.strategy, "retrieval": retrieval, "chunks": report["chunks"]}
        for k in REPORT_K:
            per = metrics.at_k(found, gold, "chunk_id", k)
            row = questions.select("qid").join(per, "qid", "left").agg(*(F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)) for c in ("recall", "precision", "rr", "ndcg"))).first()
            out |= {f"recall@{k}": row[0], f"precision@{k}": row[1], "mrr": row[2], f"ndcg@{k}": row[3]}
        stray = said.select("qid", F.explode("citations.chunk_id").alias("chunk_id")).join(found, ["qid", "chunk_id"], "left_anti")
        if not stray.isEmpty():
            raise ValueError(f"an answer cites what was not retrieved: {stray.first()}")
        good = kept(grounding(said, chunks, questions), "grounding")
        out |= {"faithfulness": _mean(good, "faithful"), "answer_terms": _mean(good, "answer_terms"), "false_refusal": _mean(said, F.col("refused").cast("int"))}
        out["true_refusal"] = _mean(p.answers(unanswerable), F.col("refused").cast("int")) if unanswerable is not None else 0.0
        out |= {"index_ms": report["millis"], "batch_ms": batch_ms}
        if timed:
            times = []
            for r in questions.orderBy("qid").limit(timed).collect():
                began = time.perf_counter()
                p.query(r.question)
                times.append(((time.perf_counter() - began) * 1000,))
            row = metrics.percentiles(spark.createDataFrame(times, "ms double"), "ms").first()
            out |= {"p50_ms": row.p50, "p95_ms": row.p95}
        return out


MODES = {"dense": {"lexical": {"enabled": False}}, "bm25": {"retrieval": {"dense_k": 0}}, "rrf": {}, "min-max": {"fusion": {"method": "weighted"}}, "rrf + rerank": {"rerank": {"provider": "heuristic"}}}
THRESHOLDS = (0.0, 0.2, 0.34, 0.5, 0.67)


def sweep(spark: SparkSession, given: dict, docs: DataFrame, questions: DataFrame, unanswerable: DataFrame | None = None) -> dict[str, list[dict]]:
    """Chunkers first; retrieval modes and refusal thresholds on the best of them by (nDCG@5, recall@5)."""
    chunkers = [evaluate(spark, variant(given, chunking={"strategy": s, "options": {}}), docs, questions, unanswerable, s) for s in chunk.DEFAULTS]
    best = max(chunkers, key=lambda r: (r["ndcg@5"], r["recall@5"]))["chunker"]
    base = {**given, "chunking": {**given.get("chunking", {}), "strategy": best}}
    retrieval = [evaluate(spark, variant(base, **o), docs, questions, unanswerable, f"{best} {m}", m) for m, o in MODES.items()]
    refusal = [{"min_support": t, **evaluate(spark, variant(base, generation={"min_support": t}), docs, questions, unanswerable, f"{best} {t:.2f}")} for t in THRESHOLDS]
    return {"chunking": chunkers, "retrieval": retrieval, "refusal": refusal}
