"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's expected copies are its source's target over its source's size. Within a source,
documents stand in order of size, so that the words taken stay near the target; their expected
copies are summed up from the first on, one offset drawn from the seed and the source's name is
added, and a document is taken once for every integer that its stretch crosses.

What a source then lacks or has too much is made up, largest first, from documents that were
rounded the other way, so that the rest is about the size of a small document. A document's
copies stay within one of its expected copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tables import documents, fresh, keep, small

#: doc_ids to a block: within a source and size, no task ranks more distinct ids than this.
BLOCK = 4_096
#: Documents of each source and each doubling of the size that may make up for a rest; four bring it under the next doubling.
SPARE = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target from a row per source: shares by weight, capped at ``most`` times the size.

    Sources in code-point order, null last, take ``weights`` in turn. With sources by
    ascending cap per weight, the level (what is left per weight left) rises while sources are
    capped and falls afterwards; its maximum is the level at which none exceeds its cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    given = sizes.withColumn("rank", rank).withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double")
    open_ = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    level = F.max("level").over(everything)
    return given.withColumn("level", left / open_).select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A fixed draw from [0, 1) in steps of 2**-20 for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(2**20))


def mix_counts(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of ``sized`` (see ``sizes``), which must be a kept table.

    Rows that share doc_id, source and size are interchangeable. Null doc_ids stand first among
    their equals, a null source is a source of its own and the last; sources of no words have
    target 0 and their documents, like an empty table's, no copies.
    """
    per_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_source = per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(per_source, weights, most)
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    first = per_size.withColumn("first", F.coalesce(F.sum("n").over(by_size), F.lit(0)))
    by_block = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(by_block), F.lit(0)))
    starts = starts.drop("n").alias("s").join(first.drop("n").alias("f"), F.expr("s.source <=> f.source and s.size = f.size")).selectExpr("s.source", "s.size", "s.block", "ahead + first AS ahead")
    goals = keep(goals, "goals")
    sources = goals.count()
    starts = starts.alias("s").join(small(goals, sources).alias("g"), F.expr("s.source <=> g.source")).selectExpr("s.*", "source_size", "target")
    own = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy(F.col("doc_id").asc_nulls_first()))
    placed = sized.withColumn("own", own).alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source and d.size = s.size and d.block = s.block")).selectExpr("d.doc_id", "d.source", "d.size", "source_size", "target", "ahead + own AS rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    copies = F.floor(u + rate * F.col("rank")) - F.floor(u + rate * (F.col("rank") - 1))
    placed = keep(placed.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).withColumn("rate", rate), "placed")
    changes = keep(made_up(placed), "changes")
    changed = small(changes, changes.count()).alias("c")
    rows = placed.alias("p").join(changed, F.expr("p.source <=> c.source and p.rank = c.rank"), "left")
    return rows.selectExpr("p.doc_id", "p.source", "p.size", "p.source_size", "p.target", "p.copies + coalesce(c.more, 0L) AS copies")


def made_up(placed: DataFrame) -> DataFrame:
    """source, rank, more: copies to add (1) or take off (-1), at most SPARE documents for each source and doubling of the size."""
    rest = placed.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    rest = keep(rest, "rest")
    rows = placed.alias("p").join(small(rest, rest.count()).alias("r"), F.expr("p.source <=> r.source")).selectExpr("p.source", "p.size", "p.rank", "p.copies", "p.rate", "r.rest")
    rows = rows.where("size > 0 and (rest > 0 and copies < rate or rest < 0 and copies > rate)")
    place = F.row_number().over(Window.partitionBy("source", F.length(F.bin("size"))).orderBy(F.col("size").desc(), "rank"))
    spare = rows.withColumn("place", place).where(F.col("place") <= SPARE)
    lists = spare.groupBy("source").agg(F.max("rest").alias("rest"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "rank"))).alias("spare"))
    start = F.struct(F.abs("rest").alias("rest"), F.expr("cast(array() as array<bigint>)").alias("taken"))
    fits = lambda s, x: -x["less"] <= s["rest"]
    walk = F.aggregate("spare", start, lambda s, x: F.struct(F.when(fits(s, x), s["rest"] + x["less"]).otherwise(s["rest"]).alias("rest"), F.when(fits(s, x), F.concat(s["taken"], F.array(x["rank"].cast("long")))).otherwise(s["taken"]).alias("taken")))
    return lists.select("source", F.signum("rest").cast("long").alias("more"), F.explode(walk["taken"]).alias("rank"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words (null: 0) and the block of ids; rows without an id, alike but for their size, are dealt over many."""
    ident = F.col("doc_id").cast("long")
    block = F.coalesce(F.floor(ident / BLOCK), F.lit(-(1 << 62)) - F.pmod(F.monotonically_increasing_id(), F.lit(BLOCK)))
    return docs.select(ident.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), block.alias("block"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows equal in doc_id, source and size take the most of theirs.

    Null ids and sources match themselves; documents without words and empty tables give none.
    """
    counted = mix_counts(keep(sizes(docs), "sizes"), **options)
    size, times, copy = (fresh(docs, name) for name in ("size_", "times_", "copy_"))
    taken = keep(counted.where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias(times)), "copies")
    on = F.expr(f"d.doc_id <=> t.doc_id and d.source <=> t.source and d.{size} = t.size")
    rows = docs.withColumn(size, word_count(F.col("text"))).alias("d").join(small(taken, taken.count(), 300_000).alias("t"), on).selectExpr("d.*", f"t.{times}")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = keep(sizes(documents(spark, sf_dir)), "sizes")
    return mix_counts(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = rf"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
given AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, ((sid - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM given),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
goals AS (SELECT source, sid, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target,
    ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM levels),
ranked AS (SELECT d.doc_id, d.size, g.sid, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY g.sid ORDER BY d.size, d.doc_id NULLS FIRST) AS rank
    FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
placed AS MATERIALIZED (SELECT *, least(floor(u + rate * rank) - floor(u + rate * (rank - 1)), 3)::BIGINT AS copies FROM ranked),
rests AS (SELECT sid, max(target) - sum(copies * size)::DOUBLE AS rest FROM placed GROUP BY sid),
spare AS (SELECT sid, size, rank, rest FROM placed JOIN rests USING (sid) WHERE size > 0 AND (rest > 0 AND copies < rate OR rest < 0 AND copies > rate)
    QUALIFY row_number() OVER (PARTITION BY sid, len(bin(size)) ORDER BY size DESC, rank) <= {SPARE}),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY size DESC, rank) AS k FROM spare),
walk AS (SELECT sid, 0::BIGINT AS k, 0::BIGINT AS rank, abs(rest) AS rest, false AS taken FROM rests
    UNION ALL SELECT s.sid, s.k, s.rank, CASE WHEN s.size <= w.rest THEN w.rest - s.size ELSE w.rest END, s.size <= w.rest FROM walk w JOIN steps s ON s.sid = w.sid AND s.k = w.k + 1)
SELECT doc_id, size, source_size, target, (copies + CASE WHEN w.taken THEN sign(r.rest) ELSE 0 END)::BIGINT * size AS taken FROM placed p JOIN rests r USING (sid) LEFT JOIN walk w ON w.sid = p.sid AND w.rank = p.rank AND w.k > 0
"""
