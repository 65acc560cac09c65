"""Secret scan: three fixed patterns and automata inferred from the credentials they find.

The patterns' values are the labelled credentials. Their prefix tree over character classes is
reduced by merging states whose frequencies a Hoeffding bound cannot tell apart (ALERGIA), which
leaves a probabilistic automaton of credential formats. Ordinary long strings give a background
chain over the same classes. Every other string of 8 characters or more is scored by its log likelihood
under the automaton less that under the background. The threshold is a low quantile of the credentials'
own scores; ordinary strings that reach it may be unlabelled credentials and leave the background.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tables import documents, drop, fresh, keep

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(rb"[0-9a-f]{32,}")
STRING = re.compile(rb"[A-Za-z0-9+/_.=-]{8,}")
KINDS = ("assign", "access", "hex", "format")
#: Labelled credentials and ordinary strings that the models are fitted on, at most; the ones with the least hashes.
SAMPLE = 2_000
#: ALERGIA's confidence parameter.
ALPHA = 0.05
#: Share of the labelled credentials that may fall below the threshold.
TAIL = 0.01
#: Judged class sequences that a task remembers.
HELD = 200_000

_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"_-", b".")):
    _CLASS[list(_chars)] = _k
_SHAPE = _CLASS.tobytes()
CLASSES, END = 8, 8
#: Characters to a class, for the likelihood of one of them.
_SPREAD = np.log(np.array([10, 6, 20, 6, 20, 2, 1, 3, 1], float))


class Automaton:
    """A probabilistic automaton by state merging; ``next[s][c]`` and ``count[s][c]``, END for the end."""

    def __init__(self, words: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        for w in words:
            s = 0
            for c in _CLASS[np.frombuffer(w, np.uint8)].tolist():
                self.count[s][c] = self.count[s].get(c, 0) + 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                s = self.next[s][c]
            self.count[s][END] = self.count[s].get(END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _total(self, s: int) -> int:
        return sum(self.count[s].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether a Hoeffding bound tells the states apart, or any that the same classes lead to; b is still a tree, so there are no more of these than states below it."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self._total(x), self._total(y)
            if not n or not m:
                continue
            limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in self.count[x].keys() | self.count[y].keys():
                if abs(self.count[x].get(c, 0) / n - self.count[y].get(c, 0) / m) > limit:
                    return False
                if c in self.next[x] and c in self.next[y] and (self.next[x][c], self.next[y][c]) != (x, y):
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree at b to the state a; b is still a tree."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            for c, n in self.count[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + n
            for c, t in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], t))
                else:
                    self.next[x][c] = t

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            at = min(range(len(blue)), key=lambda i: (-self._total(self.next[blue[i][0]][blue[i][1]]), blue[i]))
            s, c = blue.pop(at)
            b = self.next[s][c]
            for r in red:
                if self._alike(r, b):
                    self.next[s][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            known = set(red)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in known]
        self.states = red

    def score(self, w: bytes) -> float:
        """Natural log likelihood, with a little room for classes and ends never seen in a state."""
        s, out = 0, 0.0
        for c in [*_CLASS[np.frombuffer(w, np.uint8)].tolist(), END]:
            n = self._total(s) if s >= 0 else 0
            out += math.log((self.count[s].get(c, 0) + 0.01 if s >= 0 else 0.01) / (n + 0.01 * (CLASSES + 1))) - _SPREAD[c]
            s = self.next[s].get(c, -1) if s >= 0 else -1
        return out


class Chain:
    """The background: classes by the class before."""

    def __init__(self, words: list[bytes]):
        n = np.full((CLASSES + 1, CLASSES + 1), 0.5)
        for w in words:
            c = np.concatenate([[END], _CLASS[np.frombuffer(w, np.uint8)], [END]])
            np.add.at(n, (c[:-1], c[1:]), 1)
        self.log = np.log(n / n.sum(1, keepdims=True)) - _SPREAD

    def score(self, w: bytes) -> float:
        c = np.concatenate([[END], _CLASS[np.frombuffer(w, np.uint8)], [END]])
        return float(self.log[c[:-1], c[1:]].sum())


class Formats:
    """Decides whether a string looks like the labelled credentials."""

    def __init__(self, credentials: list[bytes], ordinary: list[bytes]):
        self.machine, self.ground = Automaton(credentials), Chain(ordinary)
        for _ in range(10):
            self.least = max([0.0, *([np.quantile([self.likeness(w) for w in credentials], TAIL)] if credentials else [])])
            # half the strings stay, whatever they score
            plain = sorted(ordinary, key=lambda w: (self.likeness(w), w))
            clean = [w for i, w in enumerate(plain) if 2 * i < len(plain) or not self.fits(w)]
            if len(clean) == len(ordinary):
                break
            ordinary, self.ground = clean, Chain(clean)

    def likeness(self, w: bytes) -> float:
        return (self.machine.score(w) - self.ground.score(w)) / (len(w) + 1)

    def fits(self, w: bytes) -> bool:
        return self.likeness(w) > self.least


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, credential) in bytes, leftmost non-overlapping per kind."""
    found = [(0, *m.span(), text[m.start(2) : m.end(2)]) for m in ASSIGN.finditer(text.lower()) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(2, *m.span(), m[0]) for m in HEX_RUN.finditer(text)]


class Covered:
    """Tells whether a stretch overlaps any of some spans."""

    def __init__(self, base: list[tuple[int, int, int, bytes]]):
        spans = sorted((a, b) for _, a, b, _ in base)
        self.starts, self.ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def overlaps(self, a: int, b: int) -> bool:
        n = bisect_left(self.starts, b)
        return n > 0 and self.ends[n - 1] > a


def _name(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)


def sampled(docs: DataFrame) -> DataFrame:
    """label, name, string: each task's credentials (1) and ordinary strings (0) with the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: tuple[dict, dict] = ({}, {})
        most = [2**63, 2**63]

        def take(label: int, w: bytes) -> None:
            held = least[label]
            if w in held or (name := _name(w)) > most[label]:
                return
            held[w] = name
            if len(held) >= 4 * SAMPLE:
                order = sorted(held, key=held.get)
                most[label] = held[order[SAMPLE - 1]]
                for x in order[SAMPLE:]:
                    del held[x]

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                text = value.as_py() or b""
                base = base_spans(text)
                for *_, w in base:
                    take(1, w)
                covered = Covered(base)
                for m in STRING.finditer(text):
                    if not covered.overlaps(*m.span()):
                        take(0, m[0])
        chosen = [(label, _name(w), w.decode()) for label in (0, 1) for w in heapq.nsmallest(SAMPLE, least[label], key=_name)]
        columns = list(zip(*chosen)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()))], ["label", "name", "string"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "label int, name long, string string")


def span_finder(docs: DataFrame):
    """A function from a text column to its spans, array<struct<kind, start, end>>, with the models fitted on ``docs``."""
    drawn = keep(sampled(docs).distinct(), "samples")
    rows = [r for label in (0, 1) for r in drawn.where(F.col("label") == label).orderBy("name", "string").limit(SAMPLE).collect()]
    credentials = [r.string.encode() for r in rows if r.label == 1]
    ordinary = [r.string.encode() for r in rows if r.label == 0]
    drop(drawn)  # it holds credentials
    model = docs.sparkSession.sparkContext.broadcast(Formats(credentials, ordinary) if credentials else None)  # SAMPLE strings at most
    judged: dict[bytes, bool] = {}

    def fits(w: bytes) -> bool:
        shape = w.translate(_SHAPE)  # scores go by classes only
        if shape not in judged:
            if len(judged) >= HELD:
                judged.clear()
            judged[shape] = bool(model.value.fits(w))
        return judged[shape]

    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            text = (value or "").encode("utf-8", "replace")
            base = base_spans(text)
            found = [(a, k, b) for k, a, b, _ in base]
            if model.value is not None:
                covered = Covered(base)
                for m in STRING.finditer(text):
                    if fits(m[0]) and not covered.overlaps(*m.span()):
                        found.append((m.start(), 3, m.end()))
            found.sort()
            places = np.array([(a, b) for a, _, b in found], np.int64).reshape(-1, 2)
            if len(places) and not text.isascii():  # from bytes to code points
                places = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[places]
            out.append([{"kind": k, "start": a, "end": b} for (_, k, _), (a, b) in zip(found, places.tolist(), strict=True)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(spans, "array<struct<kind:int,start:long,end:long>>")


def found_secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id and spans, by start and then kind, in code points, ends exclusive.

    Base spans always stay; strings that only the automaton finds are of kind 3 (``format``).
    Null and empty texts have none, an empty table has no rows, and repeated rows fare alike.
    Texts are searched whole, however long. Without labelled credentials nothing is added.
    """
    return docs.select(F.col("doc_id").cast("long"), span_finder(docs)(F.col("text").cast("string")).alias("spans"))


def written(spans):
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with found strings replaced by ``mark``, overlapping spans as one; each row by its own text, whatever its doc_id.

    Null texts stay null, and an empty table stays empty.
    """
    spans, name = span_finder(docs), fresh(docs, "spans_")
    rest = F.aggregate(
        name,
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["text"]).alias("text"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["text"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    rows = docs.withColumn(name, spans(F.col("text").cast("string")))
    return rows.withColumn("text", F.when(F.size(name) == 0, F.col("text")).otherwise(rest)).select(*docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_secrets(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
