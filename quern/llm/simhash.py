"""Document fingerprints by SimHash, in DataFrame operations only.

Terms are pairs of neighbouring words (a single word stands for itself); each occurrence votes,
so a term weighs as often as it occurs. A term has 128 hash bits. Votes are counted four bits to
a long: (h >> k) & 0x1000100010001 adds bits k, k + 16, k + 32 and k + 48 to a quarter each, so
32 sums count 128 bits. The top quarter holds 32,767 votes, so the terms of a text are counted in
runs of 16,384, whose sums are then added up with two bits to a long. A bit is set when over half of
the votes set it.

The search cuts the 128 bits into six blocks. Fingerprints within RADIUS bits differ by two bits
or fewer in one of them, so there is a table for each block, the bits permuted to have it in
front, and a query looks up its block with every choice of up to two bits flipped.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tables import documents, keep

BITS = 128
_LANES, _HALVES, _RUN = 0x0001000100010001, 0x0000FFFF0000FFFF, 14
#: Blocks, and bits that may differ in one: all fingerprints within BLOCKS * (FLIPS + 1) - 1 bits are found.
BLOCKS, FLIPS = 6, 2
#: Pairs at a similarity of 0.8 or more were 7 bits apart in the median and 14 at most (all 18 that sf0.01 has), texts
#: edited until they are just that alike 12 in the median, unrelated texts 42 or more. More flips or fewer, longer
#: blocks suit more than a billion documents, as they leave fewer to a place.
RADIUS = BLOCKS * (FLIPS + 1) - 1


def word_pairs(text: Column) -> Column:
    """Structs a, b of neighbouring words; the last word has no b, and an empty text one empty a."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))


def counts(size: Column, a: Column, b: Column) -> Column:
    """Whether one of ``size`` pairs is a term: the last word stands for itself only if it is alone."""
    return b.isNotNull() | ((size == 1) & (a != ""))


def term_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, F.coalesce(b, a))


def terms(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words; a lone word is its own term, no word none."""
    pairs = word_pairs(text)
    return F.transform(F.filter(pairs, lambda p: counts(F.size(pairs), p["a"], p["b"])), lambda p: term_hash(p["a"], p["b"]))


def fingerprints(texts: DataFrame, key: list[str], text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of ``texts``: the key, the columns ``extra`` of longs, and ``f1``, ``f2``, two longs of 64 bits.

    Texts without words have no votes and all bits unset. The key only says how rows lie
    together: a table dealt by some of it is not dealt again.
    """
    rows = texts.select(*key, *extra, F.monotonically_increasing_id().alias("row"), word_pairs(F.col(text)).alias("pairs"))
    # exploded as words: hashing them afterwards is compiled, functions over arrays are not
    votes = rows.select(*key, *extra, "row", F.size("pairs").alias("size"), F.posexplode("pairs").alias("pos", "pair"))
    votes = votes.withColumn("run", F.shiftright("pos", _RUN)).withColumn("h", F.when(counts(F.col("size"), F.col("pair.a"), F.col("pair.b")), term_hash(F.col("pair.a"), F.col("pair.b"))))
    votes = votes.withColumn("g", F.when(F.col("h").isNotNull(), F.xxhash64("h", F.lit(1))))
    most = [F.max(c).alias(c) for c in extra]
    sums = [F.sum(F.shiftright(c, k).bitwiseAND(F.lit(_LANES))).alias(f"{c}{k}") for c in ("h", "g") for k in range(16)]
    counted = votes.groupBy(*key, "row", "run").agg(F.count("h").alias("n"), *most, *sums)
    lanes = lambda c, k: F.sum((F.col(f"{c}{k}") if k < 16 else F.shiftrightunsigned(f"{c}{k - 16}", 16)).bitwiseAND(F.lit(_HALVES)))
    counted = counted.groupBy(*key, "row").agg(F.sum("n").alias("n"), *most, *(lanes(c, k).alias(f"{c}_{k}") for c in ("h", "g") for k in range(32)))

    def packed(c: str) -> Column:
        def bit(k: int) -> Column:
            s = F.coalesce(F.col(f"{c}_{k}"), F.lit(0))
            low = F.when(s.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0))
            high = F.when(F.shiftrightunsigned(s, 32) * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k + 32)).otherwise(F.lit(0))
            return low.cast("long").bitwiseOR(high.cast("long"))

        return reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(32)))

    return counted.select(*key, *extra, packed("h").alias("f1"), packed("g").alias("f2"))


def apart(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.lit(1.0) - apart(a1, a2, b1, b2) / F.lit(float(BITS))


def shown(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def _block(i: int) -> tuple[Column, int]:
    """The bits of block ``i`` as a long, and how many they are."""
    lo, hi = BITS * i // BLOCKS, BITS * (i + 1) // BLOCKS
    value, size = F.lit(0).cast("long"), 0
    for word, base in (("f1", 0), ("f2", 64)):
        a, b = max(lo, base) - base, min(hi, base + 64) - base
        if a < b:
            part = F.shiftrightunsigned(F.col(word), a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            value, size = value.bitwiseOR(F.shiftleft(part, size)), size + b - a
    return value, size


def _places(flips: int) -> Column:
    """A long for each table and each choice of up to ``flips`` bits: the table above bit 32, the block's bits below."""
    out = []
    for i in range(BLOCKS):
        value, size = _block(i)
        masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(size), n)]
        table = value.bitwiseOR(F.lit(i << 32))
        flipped = (lambda v: lambda m: v.bitwiseXOR(m))(table)
        out.append(F.transform(F.lit(masks).cast("array<bigint>"), flipped))
    return F.explode(F.concat(*out))


def within(queries: DataFrame, all_: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q1, q2, f1, f2) of all different fingerprints of ``all_`` within ``radius`` bits of those of ``queries``, equal ones too.

    ``radius`` is RADIUS at most. Each fingerprint stands in one place of each table; a query is looked up in
    many, and what it finds is compared in full. Equal fingerprints count once.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the tables find everything within {RADIUS} bits, not {radius}")
    tables = all_.select("f1", "f2").distinct().withColumn("place", _places(0))
    asked = queries.select("f1", "f2").distinct().withColumn("place", _places(min(FLIPS, radius)))
    # many more rows than Spark guesses, so no broadcast
    asked = asked.select(F.col("f1").alias("q1"), F.col("f2").alias("q2"), "place").hint("merge")
    near = apart(F.col("q1"), F.col("q2"), F.col("f1"), F.col("f2")) <= radius
    return tables.join(asked, "place").where(near).select("q1", "q2", "f1", "f2").distinct()


def following(ids: DataFrame) -> DataFrame:
    """k, th, n_chars, next_k, next_th from distinct ids(doc_id, k, th, n_chars), by descending doc_id, null last, round to the first after the last.

    The order is cut into ranges; positions are a range's start plus the place in it.
    """
    keys = [F.col("doc_id").desc_nulls_last(), F.col("th")]
    placed = keep(ids.repartitionByRange(*keys).sortWithinPartitions(*keys).select("k", "th", "n_chars", F.monotonically_increasing_id().alias("at")), "order")
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = keep(parts.withColumn("total", F.sum("n").over(Window.partitionBy())), "parts")  # a row per range
    at = placed.withColumn("part", part).join(F.broadcast(parts), "part").select("k", "th", "n_chars", (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("p"), "total")
    at = keep(at, "positions")
    after = at.select(F.col("k").alias("next_k"), F.col("th").alias("next_th"), "p")
    return at.withColumn("p", F.pmod(F.col("p") + 1, F.col("total"))).join(after, "p").select("k", "th", "n_chars", "next_k", "next_th")


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in doc_id and text are one document in the order and get equal results; equal
    ids with different texts follow each other by hash of the text; a null id comes last. For
    every doc_id divisible by 100, near_ids are the least doc_ids of all different fingerprints
    within RADIUS bits, its own included, and near_count their number; else both are null. Other
    columns are not read, and an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = F.col("doc_id").cast("long")
    # k and th name a document without nulls, so that joins and groups on them share exchanges
    docs = documents(spark, sf_dir).select(F.coalesce(ident, F.lit(-(2**63))).alias("k"), ident.alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text", F.col("doc_id").isNull()))
    rows = keep(docs.select("doc_id", "k", "th", F.length("text").cast("long").alias("n_chars")), "rows")
    order = keep(following(rows.distinct()), "following")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = docs.select("k", "th", "text")
    # the same columns by the same names as in the second join: one exchange of the texts serves both
    heads = docs.alias("d").join(order.alias("o"), F.expr("d.k = o.next_k and d.th = o.next_th"))
    heads = heads.select("o.k", "o.th", "n_chars", F.substring("d.text", F.lit(1), half).alias("head"))
    heads = heads.groupBy("k", "th").agg(*(F.first(c).alias(c) for c in ("n_chars", "head")))
    both = docs.join(heads, ["k", "th"])
    both = both.select("k", "th", "text", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), "head").alias("edited"))
    # the digest travels as four longs, which groups carry along cheaply
    both = both.withColumn("sha", F.sha2("edited", 256))
    longs = tuple(f"s{i}" for i in range(4))
    both = both.select("k", "th", "text", "edited", *(F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(c) for i, c in enumerate(longs)))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t"))))
    made = both.select("k", "th", *longs, kinds.alias("x")).select("k", "th", *longs, "x.e", "x.t")
    prints = keep(fingerprints(made, ["k", "th", "e"], "t", longs), "prints").distinct()
    own = prints.where("e = 0").select("k", "th", "f1", "f2")
    edited = prints.where("e = 1").select("k", "th", *longs, F.col("f1").alias("e1"), F.col("f2").alias("e2"))
    nexts = own.select(F.col("k").alias("next_k"), F.col("th").alias("next_th"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    least = own.groupBy("f1", "f2").agg(F.min(F.when(F.col("k") > -(2**63), F.col("k"))).alias("least"))
    near = within(own.where(f"k % 100 = 0 and k > {-(2**63)}"), own).join(least, ["f1", "f2"])
    near = near.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("near_count"), F.array_sort(F.collect_list("least")).alias("near_ids"))
    found = rows.join(order.select("k", "th", "next_k", "next_th"), ["k", "th"]).join(edited, ["k", "th"]).join(own, ["k", "th"]).join(nexts, ["next_k", "next_th"])
    found = found.join(near, F.expr("doc_id % 100 = 0 and f1 = q1 and f2 = q2"), "left")
    sha = F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in longs)))
    return found.select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), shown(F.col("f1"), F.col("f2")).alias("fingerprint"), shown(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        likeness(F.col("f1"), F.col("f2"), F.col("e1"), F.col("e2")).alias("near_edited"), likeness(F.col("f1"), F.col("f2"), F.col("n1"), F.col("n2")).alias("near_next"), "near_count", "near_ids",
    )
