"""Byte-level BPE encoding and decoding with pre-tokenisation on arrays.

A batch of texts becomes an array of code-point classes (letter, number, space, other). Whether
a token starts at a code point depends on transitions that either reset the state (a change of
class, an edge of a text, a contraction) or carry it on (identity); such functions compose
associatively, so running sums and shifts over the arrays do the scan that the pattern's
matcher would do left to right. Slices are told apart by a hash of their bytes, and each
distinct slice is merged once and then found in a cache. Ids are decoded again, and a text
that does not come back byte for byte is encoded anew without hashes.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tables import bounded_batches, documents
from quern.llm.words import span_hash, text_slices

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: The pattern whose matches ``token_starts`` finds; any other is refused. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct slices that a worker remembers; then it starts anew.
CACHE = 150_000
_RAW = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
#: Code points of the property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[_WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def token_starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where tokens start. ``edge`` marks first code points of texts and has one entry more than ``points``."""
    n = len(points)
    kind = classes()[points]
    fresh = edge[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    blank = points == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~edge[1:n]
    white = kind == SPACE
    # a run of spaces starts a token; so does its last space if something else follows
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    start = (fresh & (white | ~after_blank)) | last
    # contractions: an apostrophe where a match starts, then s t m d or re ve ll
    at = np.flatnonzero((points == 39) & fresh & ~after_blank)
    for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
        size = len(tail) + 1
        here = at[at + size <= n]
        for j, c in enumerate(tail, 1):
            here = here[(points[here + j] == ord(c)) & ~edge[here + j]]
        start[here + 1] = False
        end = here + size
        start[end[end < n]] = True
    return start


class Coder:
    """Encodes and decodes batches by a table of ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        by_id = sorted(table.items(), key=lambda x: x[1])
        size = by_id[-1][1] + 1
        self.length = np.zeros(size, np.int64)
        self.first = np.zeros(size, np.int64)
        flat, at = [], 0
        for piece, i in by_id:
            self.length[i], self.first[i] = len(piece), at
            flat.append(piece)
            at += len(piece)
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.size = array("q")
        self.flat = array("I")

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spans(self.first[ids], self.length[ids])]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text d are ids[bounds[d]:bounds[d+1]]."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        edge = np.zeros(len(points) + 1, bool)
        edge[np.searchsorted(lead, offs)] = True
        edge[-1] = True
        begin = lead[np.flatnonzero(token_starts(points, edge))] if len(points) else lead
        end = np.append(begin[1:], len(raw))[: len(begin)]
        names, where, back = np.unique(span_hash(_RAW[raw], begin, end), return_index=True, return_inverse=True) if len(begin) else (begin, begin, begin)
        if len(self.known) + len(names) > CACHE:
            self.clear()
        slot = np.array([self.known.get(h, -1) for h in names.tolist()], np.int64)
        for i in np.flatnonzero(slot < 0).tolist():
            ids = self.core._encode_single_piece(raw[begin[where[i]] : end[where[i]]].tobytes())
            slot[i] = self.known[int(names[i])] = len(self.size)
            self.size.append(len(ids))
            self.flat.extend(ids)
        size = np.array(self.size)
        first = np.cumsum(size) - size
        each = slot[back]
        ids = np.array(self.flat)[spans(first[each], size[each])] if len(each) else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(size[each])]) if len(each) else np.zeros(1, np.int64)
        bounds = ends[np.searchsorted(begin, offs)]
        if not np.array_equal(self.decode(ids), raw):
            parts = [self.exact(raw[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            ids, bounds = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, bounds

    def exact(self, text: bytes) -> np.ndarray:
        """One text without the cache."""
        s = text.decode("utf-8")
        points = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        edge = np.zeros(len(points) + 1, bool)
        edge[[0, -1]] = True
        at = [*np.flatnonzero(token_starts(points, edge)).tolist(), len(s)] if s else []
        return np.array([i for a, b in zip(at[:-1], at[1:], strict=True) for i in self.core._encode_single_piece(s[a:b].encode())], np.uint32)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes first[i] .. first[i] + size[i] - 1 of all i, end to end."""
    total = int(size.sum())
    step = np.ones(total, np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return step[:0]
    at = np.cumsum(size[full]) - size[full]
    step[at] = first[full]
    step[at[1:]] -= first[full[:-1]] + size[full[:-1]] - 1
    return np.cumsum(step)


_coders: dict[str, Coder] = {}


def coder(ranks: bytes, pattern: str) -> Coder:
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(ranks, pattern)
    return _coders[name]


def vocabulary(spark: SparkSession, path: str | None):
    """The rank file's bytes (under a megabyte), read on the driver and broadcast, and the pattern."""
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError(f"pre-tokenisation is built for {PATTERN!r}, not for {public_tokenizers.PATTERN!r}")
    bounded_batches(spark)
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read()), public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, starts array<int> (each token's first byte in the text); a null text is empty."""
    ranks, pattern = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks.value, pattern)
        for batch in batches:
            for lo, hi, raw, offs in text_slices(batch.column(1)):
                ids, bounds = c.encode(raw, offs)
                size = c.length[ids]
                start = np.cumsum(size) - size - np.repeat(offs[:-1], np.diff(bounds))
                cut = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(start.astype(np.int32)))], ["doc_id", "ids", "starts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from ``tokens(doc_id, ids)``; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    ranks, pattern = vocabulary(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks.value, pattern)
        for batch in batches:
            texts = [c.decode(np.asarray(x.as_py() or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids as little-endian 32-bit integers and of the decoded bytes; the ids too if asked for.

    A row for each row of ``docs``, whatever its doc_id, other columns unread; null and empty
    texts have no tokens, a long text is encoded whole, equal texts alike, and an empty table
    gives an empty one.
    """
    ranks, pattern = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks.value, pattern)
        for batch in batches:
            for lo, hi, raw, offs in text_slices(batch.column(1)):
                ids, bounds = c.encode(raw, offs)
                back = c.decode(ids)
                at = np.concatenate([[0], np.cumsum(c.length[ids])])[bounds]
                packed = ids.astype("<u4")
                docs_ = range(hi - lo)
                more = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(packed[bounds[d] : bounds[d + 1]]).hexdigest() for d in docs_], pa.string()),
                        pa.array([hashlib.sha256(back[at[d] : at[d + 1]]).hexdigest() for d in docs_], pa.string()),
                        *more,
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
