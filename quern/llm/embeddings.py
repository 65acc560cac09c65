"""Near-duplicate embeddings by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Pivots cut a
label's vectors into cells, each vector at home in that of its nearest pivot. If x lies within
r of a point of cell j, then x is within r of the plane between its own pivot i and j, that is
(d(x,j)^2 - d(x,i)^2) / (2 d(i,j)) <= r (the triangle inequality, sharpened for Euclidean space);
x is copied to these cells only, and cells join on their own. A cell with many rows is cut into
chunks, and pairs of chunks are the tasks, so that no task holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.tables import keep

#: Rows to a cell and to a chunk, about; pivots in all, at most (each 8 bytes a dimension on every executor).
CELL, CHUNK, PIVOTS = 4_000, 2_048, 4_096
#: Room for rounding in the bounds; pairs are decided by the cosine in double precision.
SLACK = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: id, label and vector not null, components finite, length over 0."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~bad & some)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    # scaled first, so that huge and tiny components keep their squares finite
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def pivots(points: DataFrame) -> dict:
    """(label, dimension) -> unit pivots: each label's vectors with the least hashes, in proportion to its rows."""
    total = points.count()
    if not total:
        return {}
    rate = min(1.0 / CELL, PIVOTS / 2 / total)
    steps = 1 << 30
    mark = F.pmod(F.xxhash64(F.lit(5), "vector"), F.lit(steps))
    drawn = points.where(mark < max(1, int(rate * steps))).select("label", "size", "vector").limit(PIVOTS)
    out: dict = {}
    for r in drawn.collect():  # PIVOTS rows at most
        out.setdefault((r.label, r.size), []).append(r.vector)
    return {k: _unit(np.array(v, np.float64)) for k, v in out.items()}


def links(points: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(edges, degrees) over the classes of ``points(id, label, size, vector, copies)``.

    edges(a, b) join what is linked in a star for each task; degrees(id, n) counts linked rows.
    """
    spark = points.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    known = spark.sparkContext.broadcast(pivots(points))

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (label, size), at in f.groupby(["label", "size"]).indices.items():
                part = f.iloc[at]
                centres = known.value.get((label, size))
                if centres is None:
                    yield part.assign(cell=0, home=True)
                    continue
                between = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
                for lo in range(0, len(part), 1024):
                    rows = part.iloc[lo : lo + 1024]
                    square = np.maximum(0, 2 - 2 * _unit(_matrix(rows["vector"])) @ centres.T)
                    own = square.argmin(1)
                    gap = square - square[np.arange(len(own)), own][:, None]
                    reach = gap <= 2 * (radius + SLACK) * between[own] + SLACK
                    reach[np.arange(len(own)), own] = True
                    row, cell = np.nonzero(reach)
                    yield rows.iloc[row].assign(cell=cell, home=cell == own[row])

    schema = "id long, label long, size int, vector array<double>, copies long, cell int, home boolean"
    placed = keep(points.select("id", "label", "size", "vector", "copies").mapInPandas(homes, schema), "placed")
    cells = placed.groupBy("label", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = keep(cells.select("label", "size", "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "cells")
    dealt = placed.join(F.broadcast(cells) if cells.count() <= 100_000 else cells, ["label", "size", "cell"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("chunks").cast("long")).cast("int"))
    # a home row is asked in (own, every chunk), any row answers in (every chunk, own)
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    asks = dealt.where("home").withColumn("other", every).select("label", "size", "cell", F.col("own").alias("p"), F.col("other").alias("q"), F.lit(True).alias("asks"), "id", "vector", "copies")
    answers = dealt.withColumn("other", every).select("label", "size", "cell", F.col("other").alias("p"), F.col("own").alias("q"), F.lit(False).alias("asks"), "id", "vector", "copies")

    def join(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["asks"]], f[~f["asks"]]
        out: list = []
        if len(left) and len(right):
            right_unit, right_id, right_copies = _unit(_matrix(right["vector"])), right["id"].to_numpy(), right["copies"].to_numpy()
            for lo in range(0, len(left), 256):
                rows = left.iloc[lo : lo + 256]
                ids = rows["id"].to_numpy()
                near = (_unit(_matrix(rows["vector"])) @ right_unit.T >= cosine) & (ids[:, None] != right_id)
                degree = near @ right_copies
                hit = near.any(1)
                # each asker is tied to its least partner and, through it, to the others of the task
                for i in np.flatnonzero(hit).tolist():
                    partners = right_id[near[i]]
                    out.append((int(ids[i]), int(degree[i]), int(partners.min()), partners))
        ties: dict[int, int] = {}

        def root(x: int) -> int:
            while ties.setdefault(x, x) != x:
                ties[x] = ties[ties[x]]
                x = ties[x]
            return x

        for a, _, _, partners in out:
            for b in partners.tolist():
                x, y = root(a), root(b)
                if x != y:
                    ties[max(x, y)] = min(x, y)
        rows_ = [(a, n, root(a)) for a, n, _, _ in out]
        asked = {a for a, *_ in rows_}
        rows_ += [(x, 0, root(x)) for x in list(ties) if x not in asked]
        return pd.DataFrame(rows_, columns=["id", "n", "root"]).astype("int64")

    tasks = asks.unionByName(answers).groupBy("label", "size", "cell", "p", "q")
    seen = keep(tasks.applyInPandas(join, "id long, n long, root long"), "seen")
    return seen.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b"), seen.groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """A row for each row of ``vectors(id, label, vector)``: id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and the cosine in double precision is at
    least ``cosine``. Null or zero vectors and vectors with null or non-finite components link
    with nothing, nor do vectors of different lengths. Equal vectors of a label are one class
    that counts by its rows. Rows that share an id are linked as one in components, and each
    counts its links to all other rows. A null id has component null and kept false.
    """
    typed = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    good = usable(typed).withColumn("vector", F.transform("vector", lambda x: x + 0.0)).withColumn("size", F.size("vector"))
    classes = good.groupBy("label", "size", "vector").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"))
    classes = keep(classes, "classes")
    member = keep(good.select("id", "label", "vector").join(classes.where("copies > 1").select("label", "vector", F.col("id").alias("rep"), "copies"), ["label", "vector"]).select("id", "rep", "copies"), "member")
    edges, degrees = links(classes.select("id", "label", "size", "vector", "copies"), cosine)
    every = keep(edges.unionByName(member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), "edges")
    own = classes.where("copies = 1").select("id", F.col("id").alias("rep"), "copies").unionByName(member).distinct()
    count = own.join(degrees.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = typed.select("id").join(count, "id", "left").join(components(every), "id", "left")
    return found.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return near_vectors(rows, 0.98).withColumnRenamed("id", "vec_id")


OP10_SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (WITH RECURSIVE r AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(r.least, v.vec_id)) AS component_id, v.vec_id <= coalesce(r.least, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) c ON c.a = v.vec_id LEFT JOIN reach r ON r.a = v.vec_id
"""
