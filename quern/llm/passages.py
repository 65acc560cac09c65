"""Repeated passages: lines, paragraphs and stretches of them, hashed and grouped over all documents.

Every whole line and paragraph (up to a blank line) is a unit, of one word or more. Passages are
also spliced into lines and sentences, so texts are cut at line ends, after words that end in
. ! or ? and after anchor words, a quarter of all, so that a passage is cut alike wherever it
stands. From each cut a unit goes on to the first cut that leaves it LEAST words or more, and to
each cut one comes from the last such; units overlap. A unit is normalised (A-Z lower-cased,
white space between words ignored) and hashed to 128 bits. It is a repeat if the same digest
stands earlier, by (doc_id, start), in any document, and does not overlap itself there. Repeats
that touch are removed as one stretch, with offsets into the text as it was; the earliest
occurrence stays.

Digests are gone through in PASSES parts, so that only a part's units lie on disk at a time.
Very common ones, known from a sample, are dealt over SALTS places, each of which finds its
earliest; the sample decides where units are compared, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tables import documents, drop, fresh, keep, small, told_apart
from quern.llm.words import Words, mix, span_hash, text_slices, words

#: Words to a unit that is no line or paragraph, at least.
LEAST = 20
#: One word in so many is an anchor; a power of two up to 64.
RATE = 4
#: Parts of the digests; each part hashes the texts anew.
PASSES = 2
#: A digest of about COMMON occurrences or more, by one document in SAMPLED, is dealt over SALTS places;
#: it must also have a hundred thousandth of all units, so such digests are 100,000 at most.
COMMON, SAMPLED, SALTS = 2_048, 16, 64
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def anchors(raw: np.ndarray, w: Words) -> np.ndarray:
    """Words whose code points, A-Z lower-cased, add up to a multiple of RATE: by the low bits of each character's last byte."""
    final = np.ones(len(raw), bool)
    final[:-1] = (raw[1:] & 0xC0) != 0x80
    run = np.concatenate([[0], np.cumsum(np.where(final, raw & (RATE - 1), 0), dtype=np.int64)])
    return (run[w.end] - run[w.start]) % RATE == 0


def unit_bounds(raw: np.ndarray, w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of every unit of a slice, as places among the slice's words."""
    n = len(w.start)
    lines = np.cumsum(raw == 10)
    cut = anchors(raw, w) | _END[raw[w.end - 1]]
    other = w.doc[1:] != w.doc[:-1]
    passed = lines[w.start[1:]] - lines[w.start[:-1]]
    cut[:-1] |= other | (passed > 0)
    cut[-1] = True
    end = np.flatnonzero(cut) + 1
    begin = np.concatenate([[0], end[:-1]])
    to, back = np.searchsorted(end, begin + least), np.searchsorted(begin, end - least, "right") - 1
    ahead, behind = to < len(end), back >= 0
    pairs = [(begin[ahead], end[to[ahead]]), (begin[back[behind]], end[behind])]
    for much in (1, 2):  # lines, paragraphs
        edges = np.concatenate([[0], np.flatnonzero(other | (passed >= much)) + 1, [n]])
        pairs.append((edges[:-1], edges[1:]))
    begin, end = np.divmod(np.unique(np.concatenate([a * (n + 1) + b for a, b in pairs])), n + 1)
    whole = w.doc[begin] == w.doc[end - 1]
    return begin[whole], end[whole]


def units(docs: DataFrame, least: int = LEAST, part: int = 0, parts: int = 1, common: np.ndarray | None = None) -> DataFrame:
    """d1, d2, doc_id, at, to, salt: the units whose digest falls into ``part`` of ``parts``.

    at and to hold the first and last place, in code points above and in words below 32 bits.
    salt is 0, and 1 to SALTS, by doc_id, for units with d1 in the sorted array ``common``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, raw, offs in text_slices(batch.column(1)):
                w = words(raw, offs)
                if not len(w.start):
                    continue
                begin, end = unit_bounds(raw, w, least)
                d1 = span_hash(w.hash, begin, end)
                if parts > 1:
                    own = (d1 >> np.uint64(7)) % np.uint64(parts) == part
                    begin, end, d1 = begin[own], end[own], d1[own]
                d2 = span_hash(mix(w.hash, 31), begin, end)
                doc = w.doc[begin]
                point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                base, first = point[offs[:-1]][doc], w.first[doc]
                at = (point[w.start[begin]] - base << 32) | (begin - first)
                to = (point[w.end[end - 1]] - base << 32) | (end - first)
                names, signed = ids[lo + doc].astype(np.int64), d1.view(np.int64)
                salt = np.zeros(len(d1), np.int32)
                if common is not None and len(common):
                    found = common[np.minimum(np.searchsorted(common, signed), len(common) - 1)] == signed
                    salt[found] = 1 + mix(names[found].view(np.uint64), 5) % np.uint64(SALTS)
                yield pa.RecordBatch.from_arrays([pa.array(signed), pa.array(d2.view(np.int64)), pa.array(names), pa.array(at), pa.array(to), pa.array(salt)], ["d1", "d2", "doc_id", "at", "to", "salt"])

    return docs.mapInArrow(run, "d1 long, d2 long, doc_id long, at long, to long, salt int")


def common_digests(docs: DataFrame, least: int) -> np.ndarray:
    """d1 of very common digests, sorted: 100,000 at most."""
    sample = units(docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SAMPLED)) == 0), least)
    counts = keep(sample.groupBy("d1").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = [r[0] for r in counts.where(F.col("n") >= max(COMMON / SAMPLED, total / 100_000)).select("d1").collect()]
    drop(counts)
    return np.sort(np.array(found, np.int64))


def _repeats(rows: DataFrame, least: int) -> DataFrame:
    """``repeats`` of rows(doc_id, text) in which every doc_id is its own."""
    high, low = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    common = common_digests(rows, least)
    parts = []
    for part in range(PASSES):
        found = units(rows, least, part, PASSES, common)
        same = Window.partitionBy("d1", "d2", "salt")
        # the earliest occurrence of what occurs twice
        found = found.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("kept", F.min(F.struct("doc_id", "at", "to")).over(same)).where("n > 1 or salt > 0")
        parts.append(keep(found.drop("n"), "found"))
    found = reduce(DataFrame.unionByName, parts)
    if len(common):  # the earliest of each common digest's places
        first = keep(found.where("salt > 0").groupBy("d1", "d2").agg(F.min("kept").alias("first")), "first")
        found = found.join(F.broadcast(first), ["d1", "d2"], "left").withColumn("kept", F.coalesce("first", "kept"))
    again = found.where((F.col("doc_id") != F.col("kept.doc_id")) | (high("at") >= high("kept.to")))
    flagged = again.select("doc_id", high("at").alias("start"), high("to").alias("end"), low("at").alias("first"), low("to").alias("last"), F.col("kept.doc_id").alias("kept_doc_id"), high("kept.at").alias("kept_start"))
    flagged = flagged.repartition("doc_id").distinct()
    before = Window.partitionBy("doc_id").orderBy("first", "last")
    apart = F.coalesce((F.col("first") > F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    runs = flagged.withColumn("apart", apart).withColumn("run", F.sum("apart").over(before)).groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), (F.max("last") - F.min("first")).cast("long").alias("n_words"),
        F.min(F.struct("first", "kept_doc_id", "kept_start")).alias("at"),
    )
    return runs.select("doc_id", "start", "end", "n_units", "n_words", "at.kept_doc_id", "at.kept_start")


def _cut_columns(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row per removed stretch: doc_id, start, end, n_units, n_words, kept_doc_id, kept_start.

    kept_doc_id and kept_start are where the stretch's first unit stays. Documents without
    repeats have no row; nor have null and empty texts and null doc_ids. Rows equal in doc_id and
    text are one document; texts that share a doc_id are documents of their own, in order of
    their hashes, and their rows all bear that doc_id. An empty table has no rows; other columns
    of ``docs`` are not read. A text of any length is gone through whole.
    """
    rows = _cut_columns(docs)
    numbered = told_apart(rows)
    if numbered is None:
        return _repeats(rows, least)
    found = keep(_repeats(numbered.select("doc_id", "text"), least), "stretches")
    own = numbered.select("doc_id", "own")
    kept = own.select(F.col("doc_id").alias("kept_doc_id"), F.col("own").alias("kept_own"))
    return found.join(own, "doc_id").join(kept, "kept_doc_id").select(F.col("own").alias("doc_id"), "start", "end", "n_units", "n_words", F.col("kept_own").alias("kept_doc_id"), "kept_start")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with removed stretches cut out of ``text``. Rows with a null doc_id stay as they are; of rows equal in doc_id and text each is cut alike."""
    rows = _cut_columns(docs)
    numbered = told_apart(rows)
    found = _repeats(rows if numbered is None else numbered.select("doc_id", "text"), least)
    name, key = fresh(docs, "cuts"), fresh(docs, "text_hash")
    cuts = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    if numbered is not None:
        cuts = cuts.join(numbered.select("doc_id", "own", F.xxhash64("text").alias(key)), "doc_id").drop("doc_id").withColumnRenamed("own", "doc_id")
    cuts = keep(cuts, "cuts")
    rest = F.aggregate(
        name,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, c: F.struct(F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, c["start"] - s["at"])).alias("text"), c["end"].alias("at")),
        lambda s: F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    spans = cuts.agg(F.coalesce(F.sum(F.size(name) + 2), F.lit(0))).first()[0]  # 16 bytes each when broadcast
    joined = (docs if numbered is None else docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))).join(small(cuts, spans), ["doc_id"] if numbered is None else ["doc_id", key], "left")
    return joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))


#: Units by definition, joined on their normalised texts.
OP6_SQL = rf"""
WITH cut AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split_regex(text, '[^\x20\x09-\x0D]+') AS g FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
names AS (SELECT doc_id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS names FROM cut),
parts AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t, unnest(g[1:len(w)]) AS gap, len(w) AS n FROM cut),
seen AS (SELECT doc_id, i, t, n, list_sum(list_transform(string_split(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), lambda c: unicode(c))) % {RATE} = 0 OR suffix(t, '.') OR suffix(t, '!') OR suffix(t, '?') AS mark,
    coalesce(len(lead(gap) OVER d) - len(replace(lead(gap) OVER d, chr(10), '')), 9) AS passed, sum(len(gap) + len(t)) OVER d AS stop FROM parts WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
ends AS (SELECT *, mark OR passed > 0 AS cut, coalesce(lag(mark OR passed > 0) OVER d, true) AS begins, coalesce(lag(passed) OVER d, 9) AS before FROM seen WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
near AS (SELECT *, min(CASE WHEN cut THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_cut, max(CASE WHEN begins THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS last_begin,
    min(CASE WHEN passed >= 1 THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line, min(CASE WHEN passed >= 2 THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS paragraph FROM ends),
spans AS (SELECT *, lead(next_cut, {LEAST - 1}) OVER d AS ahead, lag(last_begin, {LEAST - 1}) OVER d AS behind FROM near WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT doc_id, i, ahead AS j FROM spans WHERE begins AND ahead IS NOT NULL UNION SELECT doc_id, behind, i FROM spans WHERE cut AND behind IS NOT NULL
    UNION SELECT doc_id, i, line FROM spans WHERE before >= 1 UNION SELECT doc_id, i, paragraph FROM spans WHERE before >= 2),
units AS (SELECT p.doc_id, p.i, p.j, b.stop - len(b.t) AS start, e.stop, md5(array_to_string(n.names[p.i:p.j], ' ')) AS name FROM pairs p JOIN ends b ON b.doc_id = p.doc_id AND b.i = p.i JOIN ends e ON e.doc_id = p.doc_id AND e.i = p.j JOIN names n ON n.doc_id = p.doc_id),
earliest AS (SELECT name, min((doc_id, start, stop)) AS kept FROM units GROUP BY name HAVING count(*) > 1),
flagged AS (SELECT u.*, kept, coalesce(i - 1 > max(j) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS apart
    FROM units u JOIN earliest USING (name) WHERE doc_id <> kept[1] OR start >= kept[3]),
runs AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
SELECT doc_id, min(start)::INT AS start, max(stop)::INT AS "end", count(*)::BIGINT AS n_units, (max(j) - min(i) + 1)::BIGINT AS n_words, min((i, kept[1], kept[2]))[2]::BIGINT AS kept_doc_id, min((i, kept[1], kept[2]))[3]::INT AS kept_start
FROM runs GROUP BY doc_id, run
"""
