"""Connected components of an edge table, in rounds of aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tables import drop, keep


#: A vertex of so many edges, and of a hundred thousandth of all, is a hub: its neighbours are not dealt by it.
#: There are fewer than 200,000 such, 16 bytes each where they are broadcast.
HUB, HUB_SHARE = 256, 100_000


def _rewired(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One star operation over ``total`` edges (u > v): every u hands its smallest neighbour to the others.

    The large star moves the larger neighbours of u, the small star the smaller ones and u.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    hubs = least.where(F.col("n") >= max(HUB, total / HUB_SHARE)).drop("n")
    rest = near.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.drop("n"), "u")
    moved = near.join(F.broadcast(hubs), "u").unionByName(rest)
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every vertex of ``edges(a, b)``: the smallest id that links reach.

    Alternating large and small stars (Kiveris et al. 2014); every star is written to the
    shared folder, and the end is reached when a round changes nothing. Self-links are ignored,
    repeated links count once, and an empty table gives an empty one.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = keep(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
            ).distinct()
        seen = mark
        for large in (True, False):
            old, now = now, keep(_rewired(now, mark[0], large), "edges")
            drop(old)
