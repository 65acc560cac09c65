"""A retrieval and answer engine on Spark DataFrames."""

from quern.plans.config import Config, load, variant
from quern.plans.evaluate import evaluate, sweep
from quern.plans.pipeline import Pipeline
from quern.types import Answer, Chunk, Citation, Document, QueryResult

__all__ = ["Answer", "Chunk", "Citation", "Config", "Document", "Pipeline", "QueryResult", "evaluate", "load", "sweep", "variant"]
