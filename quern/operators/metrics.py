"""Retrieval and answer metrics as joins and aggregates."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from quern.sources.tables import bounded_batches

#: Whole words of a passage, after its first, that find it in a document; shorter passages are looked for in every document.
PROBE = 5
#: Passages that go to every task at once.
PASSAGES = 50_000


def verbatim(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, gold_start, gold_end): where a passage of passages(qid, passage) first stands in a text of docs(doc_id, text).

    The second to sixth word of a passage are whole words of the text too, so each run of five words of a text is
    looked up among them, and what meets is compared. A text is gone through within its row; more passages make more passes.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").where("text is not null")
    given = passages.select("qid", "passage").where("passage is not null")
    out = StructType([given.schema["qid"], texts.schema["doc_id"], StructField("gold_start", LongType()), StructField("gold_end", LongType())])
    parts = max(1, math.ceil(given.count() / PASSAGES))
    kind = to_arrow_type(out["qid"].dataType)

    def search(part: int) -> DataFrame:
        held = (given if parts == 1 else given.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)).collect()  # PASSAGES about
        probes: dict[tuple[str, ...], list[int]] = {}
        short = []
        for i, r in enumerate(held):
            words = r.passage.split()
            if len(words) >= PROBE + 2:
                probes.setdefault(tuple(words[1 : PROBE + 1]), []).append(i)
            else:
                short.append(i)
        shared = docs.sparkSession.sparkContext.broadcast(([tuple(r) for r in held], probes, {p[0] for p in probes}, short))

        def run(batches):
            rows, probes, starts, short = shared.value
            for batch in batches:
                found = []
                for at, value in enumerate(batch.column("text")):
                    text = value.as_py()
                    words = text.split()
                    met = set(short).union(*(probes.get(tuple(words[i : i + PROBE]), ()) for i, w in enumerate(words) if w in starts))
                    found += [(at, rows[i][0], place, place + len(rows[i][1])) for i in sorted(met) if (place := text.find(rows[i][1])) >= 0]
                if found:
                    at, qids, begin, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(qids, kind), batch.column("doc_id").take(pa.array(at)), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=out.names)

        return texts.mapInArrow(run, out)

    return reduce(DataFrame.unionByName, map(search, range(parts)))


def relevant(chunks: DataFrame, gold: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(qid, key): chunks of the gold document that overlap the half-open gold span."""
    g = gold.select("qid", "doc_id", F.col("gold_start").alias("gs"), F.col("gold_end").alias("ge"))
    return chunks.join(g, "doc_id").where("start < ge and gs < end").select("qid", key).distinct()


def at_k(results: DataFrame, gold: DataFrame, key: str, k: int) -> DataFrame:
    """qid, recall, precision, rr, ndcg at k for every question with results or gold."""
    hits = results.join(gold.select("qid", key).withColumn("hit", F.lit(1)), ["qid", key], "left")
    top = F.col("rank") <= k
    hit = F.col("hit").isNotNull()
    per = hits.groupBy("qid").agg(
        F.sum(F.when(hit & top, 1).otherwise(0)).alias("found"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit & top, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    wanted = gold.select("qid", key).distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    rows = per.join(wanted, "qid", "full_outer").fillna(0, ["found", "n"]).fillna(0.0, ["gain"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("n") > 0
    return rows.select(
        "qid", F.when(some, F.col("found") / F.col("n")).otherwise(0.0).alias("recall"), (F.col("found") / F.lit(k) if k > 0 else F.lit(0.0)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(some, F.col("gain") / ideal).otherwise(0.0).alias("ndcg"),
    )


def faithfulness(refused: Column, answer_terms: Column, cited_terms: Column) -> Column:
    """1 for a refusal, else the share of distinct answer terms that the cited chunks have, 0 for an answer without terms."""
    own = F.array_distinct(answer_terms)
    missing = F.size(F.array_except(own, cited_terms))
    return F.when(refused, 1.0).when(F.size(own) == 0, 0.0).otherwise(1 - missing / F.size(own))


def without_markers(text: Column) -> Column:
    """An answer without its citation markers, which are no terms of it."""
    return F.regexp_replace(text, r"\[[0-9]{1,3}\]", " ")


def term_recall(gold_terms: Column, answer_terms: Column) -> Column:
    own = F.array_distinct(gold_terms)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, answer_terms)) / F.size(own))


#: Values around a wanted rank that are looked through, as a share of all.
_NEAR = 0.001


def _at_ranks(values: DataFrame, n: int, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0) of values(v): sketched bounds around each, then exact counts of the few values between them."""
    shares = sorted({min(1.0, max(0.0, (r + d * n) / n)) for r in ranks for d in (-_NEAR, _NEAR)})
    bounds = values.agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), 10_000)).first()[0]
    out = []
    for r in ranks:
        low, high = (bounds[shares.index(min(1.0, max(0.0, (r + d * n) / n)))] for d in (-_NEAR, _NEAR))
        low, high = (None if r <= 2 * _NEAR * n else low), (None if r >= n - 1 - 2 * _NEAR * n else high)
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("v") >= low)
        if high is not None:
            inside = inside & (F.col("v") <= high)
        below = 0 if low is None else values.where(F.col("v") < low).count()
        run = F.sum("n").over(Window.orderBy("v"))
        found = values.where(inside).groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", run).where(F.col("upto") > r - below).orderBy("v").first()
        out.append(found[0])
    return out


def percentiles(times: DataFrame, column: str) -> DataFrame:
    """One row p50, p95: the median, and the nearest rank with halves to even; nulls do not count.

    Only values near the wanted ranks come together in a task.
    """
    values = times.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = values.count()
    p50 = p95 = 0.0
    if n:
        low, high, p95 = _at_ranks(values, n, [(n - 1) // 2, n // 2, round(0.95 * (n - 1))])
        p50 = (low + high) / 2
    return times.sparkSession.createDataFrame([(p50, p95)], "p50 double, p95 double")
