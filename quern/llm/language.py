"""Language identification by hyperdimensional profiles.

A letter has a random vector of +1 and -1 drawn from its code point. A trigram's vector binds
its letters' vectors, rotated by two, one and no places. A document bundles (adds) the vectors
of its trigrams, a language bundles its documents scaled to length 1, and a document gets the
language whose bundle has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tables import bounded_batches, documents
from quern.llm.words import mix, text_slices

DIMENSIONS = 1024
#: About so many labelled documents are learned from, chosen by hash over all of them.
TRAIN_DOCS = 20_000
#: Different trigrams whose vectors (a kilobyte each) are held at once.
HELD_GRAMS = 32_768
_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """Code point to lower-case letter; 0 for everything but letters."""
    if not _folded:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    words = mix(points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64), 23)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def profiles(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Unit vectors of texts, a row each; a text without letters has a row of zeros."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    docs = len(offs) - 1
    out = np.zeros((docs, DIMENSIONS), np.float32)
    doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(lead, offs)))
    low = folded()[points]
    solid = low > 0
    if not solid.any():
        return out
    # one gap between words and at both ends of a text: a gap is put before each first letter
    first = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | (doc[1:] != doc[:-1])]))
    kept = np.flatnonzero(solid)
    low, doc = np.insert(low[kept], np.searchsorted(kept, first), 0), np.insert(doc[kept], np.searchsorted(kept, first), doc[first])
    last = np.flatnonzero(np.concatenate([doc[1:] != doc[:-1], [True]])) + 1
    low, doc = np.insert(low, last, 0), np.insert(doc, last, doc[last - 1])
    alphabet, index = np.unique(low, return_inverse=True)
    size = len(alphabet)
    gram = (index[:-2] * size + index[1:-1]) * size + index[2:]
    whole = doc[:-2] == doc[2:]
    code, count = np.unique(doc[:-2][whole] * size**3 + gram[whole], return_counts=True)
    gram, at = np.unique(code % size**3, return_inverse=True)
    if len(gram) > HELD_GRAMS and docs > 1:
        return np.concatenate([profiles(raw[a:b], np.array([0, b - a])) for a, b in zip(offs[:-1], offs[1:], strict=True)])
    letters = letter_vectors(alphabet)
    once, twice = np.roll(letters, 1, 1), np.roll(letters, 2, 1)
    ends = np.searchsorted(code, np.arange(docs + 1, dtype=np.int64) * size**3)
    step = 2048

    def vectors_of(g: np.ndarray) -> np.ndarray:
        return twice[g // size**2] * once[g // size % size] * letters[g % size]

    if len(gram) > HELD_GRAMS:  # one long text, its trigrams in order
        for k in range(0, len(gram), step):
            out[0] += count[k : k + step].astype(np.float32) @ vectors_of(gram[k : k + step]).astype(np.float32)
        return out / np.linalg.norm(out)
    vectors = np.empty((len(gram), DIMENSIONS), np.int8)
    for k in range(0, len(gram), step):
        vectors[k : k + step] = vectors_of(gram[k : k + step])
    for d in range(docs):
        lo, hi = ends[d], ends[d + 1]
        for k in range(lo, hi, step):
            out[d] += count[k : min(hi, k + step)].astype(np.float32) @ vectors[at[k : min(hi, k + step)]].astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def learned(labelled: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit bundles from ``labelled(key, text, lang)``, key a spreading long.

    About ``most`` rows are read, chosen by hash of the key among all rows with a language;
    with fewer, all are. Rows with a null key, text or lang teach nothing, texts without a letter
    add nothing, and repeated rows count each. No row with a language, or an empty table, gives
    no language.
    """
    bounded_batches(labelled.sparkSession)
    usable = labelled.where("lang is not null and text is not null and key is not null")
    total = usable.select("key").count()
    steps = 1 << 62
    if total > most:
        usable = usable.where(F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(steps)) < -(-most * steps // total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, raw, offs in text_slices(batch.column(1)):
                rows = profiles(raw, offs).astype(np.float64)
                for lang in set(langs[lo:hi]):
                    sums[lang] = sums.get(lang, 0) + np.rint(rows[langs[lo:hi] == lang] * 2**30).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])

    parts = usable.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, bundle array<long>")
    summed = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x").collect()  # a row per language
    rows = sorted((r[0], r[1]) for r in rows)
    if not rows:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    bundles = np.array([r[1] for r in rows], np.float64)
    norm = np.linalg.norm(bundles, axis=1, keepdims=True)
    return [r[0] for r in rows], (bundles / np.where(norm > 0, norm, 1)).astype(np.float32)


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score, the cosine cut to 0..1; ``und`` and 0 where a text is null, has no letter or nothing is learned.

    Ties go to the first language in order. Each text is judged alone, so equal texts fare
    alike; a long one is profiled whole, its trigrams in blocks. An empty table stays empty. The
    columns, called ``names``, replace any of these names.
    """
    langs, bundles = model
    shared = docs.sparkSession.sparkContext.broadcast(bundles)  # a vector per language
    rows = docs.drop(*names)
    at = rows.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{names[0]}` string, `{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, scores = [], []
            for _, _, raw, offs in text_slices(batch.column(at)):
                rows = profiles(raw, offs)
                like = rows @ shared.value.T if langs else np.zeros((len(rows), 1), np.float32)
                best = like.argmax(1)
                none = ~rows.any(1) if langs else np.ones(len(rows), bool)
                said += [("und" if n else langs[b]) for n, b in zip(none, best, strict=True)]
                scores.append(np.where(none, 0.0, np.clip(like[np.arange(len(best)), best].astype(np.float64), 0, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id counts as held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    docs = documents(spark, sf_dir)
    model = learned(docs.where(~held).select(F.col("doc_id").cast("long").alias("key"), "text", "lang"))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return predicted(rows, model).drop("text")
