"""Rows of the engine's tables as objects, for callers that hold few of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Document:
    doc_id: str
    text: str
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.doc_id:
            raise ValueError("doc_id must not be empty")


@dataclass(frozen=True)
class Chunk:
    """``text`` is the document's from ``start`` to ``end``, in code points."""

    chunk_id: str
    doc_id: str
    ordinal: int
    start: int
    end: int
    text: str
    heading: str = ""

    def __post_init__(self):
        if not self.start < self.end or len(self.text) != self.end - self.start:
            raise ValueError(f"{self.chunk_id}: {len(self.text)} characters from {self.start} to {self.end}")


@dataclass(frozen=True)
class Citation:
    marker: int
    chunk_id: str
    doc_id: str
    quote: str


@dataclass(frozen=True)
class Answer:
    text: str
    citations: tuple[Citation, ...] = ()
    refused: bool = False
    reason: str = ""


@dataclass(frozen=True)
class QueryResult:
    query: str
    answer: Answer
    retrieved: tuple[dict, ...]
    timings_ms: dict[str, float]

    @classmethod
    def of(cls, result: dict) -> QueryResult:
        """From what ``Pipeline.query`` returns."""
        cited = tuple(Citation(**c) for c in result["citations"])
        return cls(result["query"], Answer(result["answer"], cited, result["refused"], result["reason"]), tuple(result["retrieved"]), result["timings_ms"])

    @property
    def total_ms(self) -> float:
        return sum(self.timings_ms.values())


def documents(spark: SparkSession, given: list[Document]) -> DataFrame:
    """doc_id, text, metadata and seq, the place in the list: of equal ids the last wins when indexed."""
    rows = [(d.doc_id, d.text, {k: str(v) for k, v in d.metadata.items()}, i) for i, d in enumerate(given)]
    return spark.createDataFrame(rows, "doc_id string, text string, metadata map<string,string>, seq long")
