"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows stand in source blocks and go to target blocks. How many rows each source block sends to
each target block is drawn exactly: a binary tree over the source blocks splits the targets'
room by multivariate hypergeometric draws, each node with a generator seeded by its range, so
every task finds its own block's numbers and no matrix is ever held whole. Source blocks order
their rows by a seeded hash and deal them out by these numbers; after the exchange, target
blocks order theirs by another seeded hash. A shard is a run of target blocks, so its slots
are gapless and no task has to hold a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tables import documents, fresh, keep

#: Rows to a source or target block, about; a task sorts one.
BLOCK_ROWS = 20_000
#: Source blocks and target blocks, at most: beyond, blocks grow instead and their sorts spill, as a
#: source block draws a number for every target block on each level of the tree.
MOST_BLOCKS = 4_096
#: Equal rows that a task numbers at once.
RUN = 10_000


def even(total: int, parts: int) -> list[int]:
    """Sizes that differ by one at most and add up to ``total``."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def spread(rng: np.random.Generator, room: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric draw, one colour after another."""
    out, left = np.zeros(len(room), np.int64), int(room.sum())
    for i, n in enumerate(room.tolist()):
        if not draws:
            break
        rest = left - n
        # numpy's draws end at 10**9
        out[i] = n if rest == 0 and draws >= n else rng.hypergeometric(n, rest, draws) if left < 10**9 else _large(rng, n, rest, draws)
        draws, left = draws - int(out[i]), rest
    return out


def _large(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw for any size: the weights around the mode, by their ratios, are summed and inverted.

    Twelve standard deviations and 40 on both sides leave out less than a double can tell apart.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (total + 2)
    reach = 40 + int(12 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))))
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rising = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    falling = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    sums = np.cumsum(np.concatenate([falling[::-1], [1.0], rising]))
    return mode - len(falling) + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def row_of_matrix(block: int, counts: list[int], room: list[int], seed: int) -> np.ndarray:
    """How many rows source block ``block`` sends to each target block."""
    lo, hi, free = 0, len(counts), np.array(room, np.int64)
    ahead = np.concatenate([[0], np.cumsum(counts)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = spread(rng, free, int(ahead[mid] - ahead[lo]))
        lo, hi, free = (lo, mid, left) if block < mid else (mid, hi, free - left)
    return free


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with copy_, which numbers equal rows; groups of any size are numbered in runs of RUN, without a sort."""
    copy, n, part = (fresh(rows, name) for name in ("copy_", "n_", "part_"))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(n))
    runs = counted.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN)))).repartition(*rows.columns, part)
    return runs.withColumn(copy, F.explode(F.sequence(F.col(part) * RUN, F.least(F.col(n), (F.col(part) + 1) * RUN) - 1))).drop(n, part)


def shuffled(rows: DataFrame, shards: int = 40, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows(key, ...)`` with shard and slot: a uniform shuffle with shard sizes at most one apart.

    The result depends on the rows alone, not on how they lie: rows equal in all columns are
    interchangeable and get numbers, so that a group of them spreads like others. Null keys are
    keys. Columns must be of types that can be grouped; texts are better left out and joined by
    key. An empty table gives an empty one. Columns shard and slot in ``rows`` are not allowed.
    """
    names = rows.columns
    rows = keep(told_apart(rows), "copies")
    block, own, to = (fresh(rows, name) for name in ("block_", "own_", "to_"))
    total = rows.count()
    blocks = min(max(1, -(-total // block_rows)), MOST_BLOCKS)
    per_shard = max(1, min(-(-total // (shards * block_rows)), MOST_BLOCKS // shards))
    dealt = rows.withColumn(block, F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(blocks)).cast("int"))
    found = {r[0]: r[1] for r in dealt.groupBy(block).count().collect()}  # MOST_BLOCKS rows at most
    counts = [found.get(b, 0) for b in range(blocks)]
    sizes = even(total, shards)
    room = [n for s in sizes for n in even(s, per_shard)]

    def permuted(part: str, salt: int) -> Column:
        return F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + salt), *rows.columns), *rows.columns))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: dict[int, np.ndarray] = {}
        for f in frames:
            places = np.zeros(len(f), np.int32)
            for b, at in f.groupby(block).indices.items():
                if b not in ends:
                    ends.clear()
                    ends[b] = np.cumsum(row_of_matrix(int(b), counts, room, seed))
                places[at] = np.searchsorted(ends[b], f[own].to_numpy()[at], "left")
            f[to] = places
            yield f

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{block} int, {own} int, {to} int"])
    sent = dealt.withColumn(own, permuted(block, 1)).mapInPandas(deal, schema)
    # the target blocks of a shard start where even() puts them; there are two sizes of shards at most
    starts = [F.array(*(F.lit(int(x)) for x in np.cumsum([0, *even(s, per_shard)])[:-1])) for s in (sizes[0], sizes[-1])]
    shard, inner = F.floor(F.col(to) / per_shard).cast("int"), (F.pmod(to, F.lit(per_shard)) + 1).cast("int")
    first = F.when(shard < total % shards, F.element_at(starts[0], inner)).otherwise(F.element_at(starts[1], inner))
    return sent.withColumn("slot", (first + permuted(to, 2) - 1).cast("long")).withColumn("shard", shard).select(*names, "shard", "slot")


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty: 16 bytes, a checksum of 0. Null and repeated doc_ids are rows like others."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("key"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffled(rows)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
