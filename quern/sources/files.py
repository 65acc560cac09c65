"""Sources and sinks: directories, JSON lines, question sets, result and report files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import StoreError
from quern.functions.text import collapse_whitespace

DOCUMENT = "doc_id STRING, text STRING, metadata MAP<STRING, STRING>"


def read_directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """doc_id (path below ``path``), text, source, kind of all non-blank files with a suffix, in any case, at any depth."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    root = path.removeprefix("file://").rstrip("/") + "/"
    rows = files.select(name.alias("p"), F.col("value").alias("text")).withColumn("doc_id", F.expr(f"substring(p, instr(p, '{root}') + {len(root)})"))
    kind = F.lower(F.regexp_extract("doc_id", r"(\.[^./]+)$", 1))
    return rows.withColumn("kind", kind).where(F.col("kind").isin(*suffixes) & (collapse_whitespace(F.col("text")) != "")).select("doc_id", "text", F.lit(path).alias("source"), "kind")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path).where("doc_id is not null")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, answer, doc_id and the gold span, half-open in code points."""
    return spark.read.schema("qid STRING, question STRING, answer STRING, doc_id STRING, gold_start INT, gold_end INT, kind STRING").json(path).where("qid is not null")


def read_unanswerable(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid STRING, question STRING").json(path).where("qid is not null")


def inline_documents(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """1 to 500 documents {doc_id, text, metadata}; other keys and non-scalar metadata are refused."""
    if not 1 <= len(documents) <= 500:
        raise StoreError("give 1 to 500 documents")
    rows = []
    for d in documents:
        if set(d) - {"doc_id", "text", "metadata"}:
            raise StoreError(f"unknown keys: {sorted(set(d) - {'doc_id', 'text', 'metadata'})}")
        meta = d.get("metadata") or {}
        if not 1 <= len(d.get("doc_id", "")) <= 200 or not d.get("text") or not all(isinstance(v, (str, int, float, bool)) for v in meta.values()):
            raise StoreError(f"bad document {d.get('doc_id')!r}")
        rows.append((d["doc_id"], d["text"], {k: json.dumps(v) if not isinstance(v, str) else v for k, v in meta.items()}))
    return spark.createDataFrame(rows, DOCUMENT)


def scan(table: DataFrame) -> DataFrame:
    """A chunk table in its one order."""
    return table.orderBy("doc_id", "ordinal")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def markdown(rows: list[dict]) -> str:
    """A table of a report's few rows; three decimals, one for columns that end in _ms."""
    if not rows:
        return ""
    show = lambda k, v: (f"{v:.1f}" if k.endswith("_ms") else f"{v:.3f}") if isinstance(v, float) else str(v)
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(show(k, r[k]) for k in head) + " |" for r in rows)])


def write_report(report: dict, path: str) -> None:
    """A report as JSON, indented by two, other alphabets as they are."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)
        f.write("\n")
