"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidate edges.

Every shingle is hashed once; the top of the hash picks one of ROWS * BANDS bins, and a bin
keeps its least hash. Empty bins borrow from full ones by optimal densification (Shrivastava
2017). A document is known by 16 bits of each bin, its mark. BANDS groups of ROWS bins are
bucket keys: at a similarity of 0.8 a pair shares no bucket with probability
(1 - 0.8**8)**48 < 2e-4, at 0.85 with (1 - 0.85**8)**48 < 3e-7.

First, each bucket's least id is tied to the others in a star, so that a group of copies costs
a pair for each member and bucket. Confirmed stars give components. Buckets that still hold
several components are then gone through in blocks: members outside a bucket's largest component
meet the others, and two of different components go on if their marks agree enough, in the
first bucket that they share only. So no link is lost to the stars, and no pairs are made
within a component or for unlike members.

Where over LARGE members are outside the largest component, all pairs would be too many. The
members of such buckets are joined on their rarest shingles instead: of two sets that overlap by
``percent``, each holds one of the other's rarest shingles among so many of its own as it may
lack and one more. What a large bucket's texts have in common is frequent, so it ties no groups there.

Pairs are confirmed on the full shingle sets, which are made anew from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.tables import documents, drop, keep, small
from quern.llm.words import mix, shingle_sets, text_slices

BANDS, ROWS = 48, 8
#: Rounds of densification by random bins; a bin that is empty still takes the next full one.
TRIES = 64
#: Sets of at least SIGNED shingles are compared by marks first: bins that agree estimate the similarity
#: with a standard deviation of 0.02 at most, and a pair goes on from ``percent`` less MARGIN, six of these.
SIGNED, MARGIN = 48, 0.12
#: Members of a bucket to a block; a task holds two.
BLOCK = 512
#: Members of a bucket outside its largest component that are compared with all others; beyond, rare shingles are joined.
LARGE = 4_096


def signatures(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, a row for each non-empty set."""
    count = np.diff(bounds)
    full_sets = np.flatnonzero(count)
    doc = np.repeat(np.arange(len(full_sets)), count[full_sets])
    cell = doc * bins + (((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    sig = np.zeros(len(full_sets) * bins, np.uint64)
    have = np.zeros(len(full_sets) * bins, bool)
    sig[cell[lead]], have[cell[lead]] = values[lead], True
    sig, have = sig.reshape(-1, bins), have.reshape(-1, bins)
    d, b = np.nonzero(~have)
    filled = sig.copy()
    for t in range(TRIES):
        if not len(d):
            break
        pick = (mix(b.astype(np.uint64) * np.uint64(TRIES) + np.uint64(t), 11) % np.uint64(bins)).astype(np.int64)
        ok = have[d, pick]
        filled[d[ok], b[ok]] = sig[d[ok], pick[ok]]
        d, b = d[~ok], b[~ok]
    for k in range(1, bins):
        if not len(d):
            break
        pick = (b + k) % bins
        ok = have[d, pick]
        filled[d[ok], b[ok]] = sig[d[ok], pick[ok]]
        d, b = d[~ok], b[~ok]
    return filled


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, and its mark."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, offs in text_slices(batch.column(1)):
                values, bounds = shingle_sets(raw, offs, width)
                count = np.diff(bounds)
                names = []
                for salt in (3, 5):
                    total = np.concatenate([[0], np.cumsum(mix(values, salt), dtype=np.uint64)]).astype(np.uint64)
                    names.append(mix(total[bounds[1:]] - total[bounds[:-1]], salt).view(np.int64))
                low = mix(signatures(values, bounds, bins), 2).astype("<u2").tobytes()
                at = np.cumsum(np.concatenate([[0], np.where(count > 0, 2 * bins, 0)]))
                marks = pa.array([low[at[i] : at[i + 1]] for i in range(len(count))], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(count.astype(np.int64)), *(pa.array(n) for n in names), marks], ["doc_id", "n_shingles", "set_a", "set_b", "mark"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, mark binary")


def bucket_keys(bands: int, rows: int) -> Column:
    """A key for each band of the column ``mark``; the band is part of the key."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("mark", i * (2 * rows) + 1, F.lit(2 * rows)))))


def likely(one: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of marks (rows of two arrays) of sets of n and m shingles may be linked."""
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & ((np.minimum(n, m) < SIGNED) | ((one == other).mean(-1) >= percent / 100 - MARGIN))


def _likely(percent: int):
    def judge(ma: pd.Series, mb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ma):
            return pd.Series([], dtype=bool)
        one, other = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (ma, mb))
        return pd.Series(likely(one, other, na.to_numpy(), nb.to_numpy(), percent))

    return F.pandas_udf(judge, "boolean")


def open_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(key, first, id) with their component c, and of each key with several: total, asks (members outside the largest component), major (that component)."""
    known = members.join(labels, "id", "left").select("key", "first", "id", F.coalesce("component_id", "id").alias("c"))
    per = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    info = per.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return known, info.select("key", "total", (F.col("total") - F.col("top.n")).alias("asks"), F.col("top.c").alias("major"))


def across(members: DataFrame, bands: int, rows: int, percent: int, banded: bool = True) -> DataFrame:
    """Likely pairs between components, from members(key, first, id, c, n, mark, total, asks, major): a row per unit of work.

    A bucket of over BLOCK members is dealt into blocks: those outside its largest component ask,
    all answer, and pairs of an asking and an answering block are the units (key, p, q). Rows
    come sorted by these, so a task holds one unit. A unit's row has the ids of its likely pairs
    and the pairs as places among them. In a bucket of a band, a pair is given if that is the
    first that its marks share, and not for the bucket's centre, which its star has compared.
    """
    none, pair = F.expr("cast(array() as array<struct<p:int,q:int,role:int>>)"), lambda p, q, role: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(role).alias("role"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), blocks(n).cast("long"))
    asking = F.when(F.col("c") == F.col("major"), none).otherwise(F.transform(F.sequence(F.lit(0), blocks("total") - 1), lambda q: pair(own(9, "asks"), q, 0)))
    answering = F.transform(F.sequence(F.lit(0), blocks("asks") - 1), lambda p: pair(p, own(10, "total"), 1))
    places = F.when(F.col("total") <= BLOCK, F.array(pair(F.lit(0), F.lit(0), 2))).otherwise(F.concat(asking, answering))
    units = members.withColumn("u", F.explode(places)).select("key", "u.p", "u.q", "u.role", (F.col("c") == F.col("major")).cast("int").alias("big"), F.coalesce("first", F.lit(-(2**63))).alias("first"), "id", "c", "n", "mark")

    def pairs(unit: list[tuple]) -> tuple[list[int], list[int], list[int]]:
        role, big, first, ids, c, n = (np.array([r[i] for r in unit], np.int64) for i in range(6))
        marks = np.frombuffer(b"".join(r[6] for r in unit), np.uint16).reshape(len(unit), -1)
        # the unit's own band, if its marks share just one
        shared = np.flatnonzero((marks == marks[0]).reshape(len(unit), bands, rows).all((0, 2))) if banded else ()
        band = int(shared[0]) if len(shared) == 1 else -1
        used: dict[int, int] = {}
        left: list[int] = []
        right: list[int] = []
        answers = (role > 0) & (ids != first)
        for i in np.flatnonzero((role != 1) & (big == 0) & (ids != first)):
            # those that ask too meet once, by the smaller id
            rest = np.flatnonzero(answers & ((big == 1) | (ids > ids[i])) & (c != c[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            rest = rest[likely(marks[rest], marks[i], n[rest], n[i], percent)]
            if band >= 0 and len(rest):
                rest = rest[(marks[rest] == marks[i]).reshape(len(rest), bands, rows).all(2).argmax(1) == band]
            for j in rest.tolist():
                left.append(used.setdefault(int(ids[i]), len(used)))
                right.append(used.setdefault(int(ids[j]), len(used)))
        return list(used), left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if len(unit) > 1:
                ids, left, right = pairs(unit)
                if left:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x], t) for x, t in zip(now, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array([ids], pa.list_(pa.int64())), pa.array([left], pa.list_(pa.int32())), pa.array([right], pa.list_(pa.int32()))],
                        ["key", "p", "q", "ids", "left", "right"],
                    )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if row[:3] != now:
                    yield from out()
                    now, unit = row[:3], []
                unit.append(row[3:])
        yield from out()

    return units.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "key long, p int, q int, ids array<long>, left array<int>, right array<int>")


def rare_shingles(ids: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, id): the rarest shingles of each set of ids(id), by how many of these sets hold them, as many as a linked set may lack and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in text_slices(batch.column(2)):
                values, bounds = shingle_sets(raw, offs, width)
                count = np.diff(bounds)
                own = [np.repeat(batch.column(i).to_numpy()[lo:hi], count) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), pa.array(np.repeat(count, count)), pa.array(values.view(np.int64))], ["id", "text_hash", "n", "key"])

    texts = texts_of(ids, docs).select("id", F.xxhash64("text").alias("text_hash"), "text")
    held = keep(texts.mapInArrow(run, "id long, text_hash long, n long, key long"), "shingles")
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("id", "text_hash").orderBy("often", "key")
    prefix = F.floor(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    chosen = held.join(often, "key").withColumn("place", F.row_number().over(order)).where(F.col("place") <= prefix)
    return chosen.where("often > 1").select("key", "id").distinct()


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``ids(id)``."""
    ids = keep(ids.distinct(), "ids")
    return keep(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(small(ids, ids.count()), "id", "left_semi"), "texts")


def linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    if not len(one) or not len(other):
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def confirmed_units(units: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that tie together what the pairs of ``units`` (see ``across``) tie together.

    A unit's texts come once each, after its pairs; a pair whose ends the unit has already
    tied together is passed over.
    """
    named = units.select("key", "p", "q", F.posexplode("ids").alias("i", "id"))
    none = F.lit(None).cast("array<int>")
    parts = named.join(texts_of(units.select(F.explode("ids").alias("id")), docs), "id").select("key", "p", "q", "i", "id", "text", none.alias("left"), none.alias("right"))
    heads = units.select("key", "p", "q", F.lit(-1).alias("i"), F.lit(0).cast("long").alias("id"), F.lit("").alias("text"), "left", "right")
    rows = heads.unionByName(parts).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: tuple = ((), ())
        ids: list[int] = []
        sets: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            root = list(range(len(ids)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            found = []
            for a, b in zip(*pairs, strict=True):
                x, y = find(a), find(b)
                if x != y and any(linked(s, t, percent) for s in sets[a] for t in sets[b]):
                    root[max(x, y)] = min(x, y)
                    found.append((ids[a], ids[b]))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            place, names = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for lo, _, raw, offs in text_slices(batch.column(5)):
                values, bounds = shingle_sets(raw, offs, width)
                for i in range(len(offs) - 1):
                    at = place[lo + i]
                    if at < 0:
                        yield out()
                        pairs, ids, sets = (batch.column(6)[lo + i].as_py(), batch.column(7)[lo + i].as_py()), [], []
                        continue
                    while len(sets) <= at:
                        sets.append([])
                        ids.append(names[lo + i])
                    sets[at].append(values[bounds[i] : bounds[i + 1]].copy())
        yield out()

    return rows.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, salts: int = 64) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    The text of each b goes to its centre a once; a centre with many partners is dealt over
    ``salts`` places. Rows come sorted, centre first, so a task holds one set at a time.
    """
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")
    members = pairs.withColumn("salt", salt).join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    places = pairs.select("a", salt.alias("salt")).distinct()
    centres = places.join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rows = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            a, s, k, b = (batch.column(i).to_numpy() for i in range(4))
            found_a, found_b = [], []
            for lo, _, raw, offs in text_slices(batch.column(4)):
                values, bounds = shingle_sets(raw, offs, width)
                for i in range(len(offs) - 1):
                    row, own = lo + i, values[bounds[i] : bounds[i + 1]]
                    if k[row] == 0:
                        if at != (a[row], s[row]):
                            at, held = (a[row], s[row]), []
                        held.append(own.copy())
                        continue
                    if any(linked(centre, own, percent) for centre in held):
                        found_a.append(a[row])
                        found_b.append(b[row])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets of ``width``-word shingles overlap by ``percent``; component_id
    is the smallest doc_id that links reach, kept says whether that is the row's own. A null or wordless text
    has an empty set and links with nothing. Rows that share a doc_id are one document that
    links by any of its texts. A null doc_id links with nothing: component_id null, kept false.
    Other columns of ``docs`` are not read.
    """
    drawn = keep(sketch(docs, width, bands, rows), "sketch")
    marks = keep(drawn.drop("mark"), "sets")
    names = ["set_a", "set_b", "n_shingles"]
    solid = marks.where("n_shingles > 0 and doc_id is not null")
    # Equal sets first: one representative goes on, the others link to it.
    classes = keep(solid.groupBy(*names).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    copies = keep(solid.join(classes.where("rep <> last"), names).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")
    reps = keep(drawn.join(classes.withColumnRenamed("rep", "doc_id"), [*names, "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "mark"), "reps")
    drop(drawn)
    keyed = keep(reps.select(bucket_keys(bands, rows).alias("key"), "id"), "keyed")
    shared = keep(keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last"), "shared")
    members = keep(keyed.join(shared, "key").distinct(), "members")
    drop(keyed)

    # Stars
    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    one, two = (reps.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("mark").alias("m" + x)) for x in "ab")
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    sized = stars.join(one, "a").join(two, "b").where(fits)
    links = keep(confirmed(keep(sized.where(_likely(percent)("ma", "mb", "na", "nb")).select("a", "b").distinct(), "stars"), docs, width, percent), "star-links")
    labels = keep(components(links), "labels")

    # What the stars left open
    known, info = open_buckets(members.select("key", "first", "id"), labels)
    info = keep(info, "open")
    parts = [across(known.join(info.where(F.col("asks") <= LARGE), "key").join(reps, "id"), bands, rows, percent)]
    large = info.where(F.col("asks") > LARGE)
    if not large.isEmpty():
        ids = members.join(large.select("key"), "key", "left_semi").select("id")
        rare = keep(rare_shingles(ids, docs, width, percent), "rare").withColumn("first", F.lit(None).cast("long"))
        known, info = open_buckets(rare, labels)
        parts.append(across(known.join(info, "key").join(reps, "id"), bands, rows, percent, banded=False))
    for part in parts:
        links = links.unionByName(keep(confirmed_units(keep(part, "units"), docs, width, percent), "unit-links"))
    links = keep(links.unionByName(copies), "links")
    every = components(links)
    return (
        marks.select("doc_id", "n_shingles").join(every.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


#: All pairs that share a shingle, counted; for small tables.
OP1_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM sets LEFT JOIN least ON a = doc_id
"""
