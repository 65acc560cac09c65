"""Answers by a language model: messages, batches of questions, and one answer as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import ConfigError, ModelServerError
from quern.functions.text import Analyzer
from quern.operators import answer
from quern.streaming.events import JsonField, payload

INSTRUCTION = (
    "Answer the question from the numbered passages alone. After every statement put the number of its passage in square brackets. "
    "If the passages do not answer it, leave the answer empty. Reply in JSON with the fields answer and citations."
)
SCHEMA = {"type": "object", "properties": {"answer": {"type": "string"}, "citations": {"type": "array", "items": {"type": "integer"}}}, "required": ["answer", "citations"]}


def messages(question: str, passages: str) -> list[dict]:
    return [{"role": "system", "content": INSTRUCTION}, {"role": "user", "content": f"Passages:\n{passages}\n\nQuestion: {question}"}]


def failed(error: Exception) -> str:
    return f"generation failed: {error}"


def model_answers(packs: DataFrame, questions: DataFrame, client: Callable) -> DataFrame:
    """(qid, text, claimed, failure) for every question with passages; ``client()`` makes one client a partition, which has ``chat(messages, schema)``.

    A failure of the model server is a value; anything else that breaks, breaks the query.
    """
    rows = answer.context(packs).join(questions.select("qid", "question"), "qid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for f in frames:
            out = []
            for question, passages in zip(f["question"], f["context"], strict=True):
                try:
                    out.append((*payload(model.chat(messages(question, passages), SCHEMA)), None))
                except ModelServerError as e:
                    out.append(("", [], failed(e)))
            said = pd.DataFrame(out, columns=["text", "claimed", "failure"], dtype=object)
            yield said.assign(qid=f["qid"].to_numpy())[["qid", "text", "claimed", "failure"]]

    return rows.select("qid", "question", "context").mapInPandas(run, f"qid {dict(questions.dtypes)['qid']}, text string, claimed array<int>, failure string")


class ModelStream:
    """The pieces of one answer as they come, and afterwards what they add up to: text, claimed, failure."""

    def __init__(self, client, question: str, passages: str):
        self.client, self.question, self.passages = client, question, passages
        self.text, self.claimed, self.failure = "", [], None

    def __iter__(self) -> Iterator[str]:
        field = JsonField("answer")
        try:
            for fragment in self.client.stream(messages(self.question, self.passages), SCHEMA):
                if piece := field.feed(fragment):
                    yield piece
        except ModelServerError as e:
            self.failure = failed(e)
            return
        self.text, self.claimed = payload(field.raw)


def generator(provider: str, client: Callable | None = None, max_sentences: int = 3, min_support: float = 0.0, analyzer: Analyzer | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function (packs, questions) -> answers(qid, text, claimed, ...) for ``answer.enforced``."""
    if provider == "extractive":
        return lambda packs, questions: answer.extractive(packs, questions, max_sentences, min_support, analyzer=analyzer)
    if provider == "model":
        if client is None:
            raise ConfigError("the provider model needs a client")
        return lambda packs, questions: model_answers(packs, questions, client)
    raise ConfigError(f"unknown generation provider {provider!r}")
