"""The HTTP surface: health, index, query and streamed query, as a function of requests and as a WSGI application.

Run with ``python -m quern.cli serve``; every request is a Spark job over the pipeline's tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from quern.errors import QuernError, StoreError
from quern.plans.pipeline import Pipeline
from quern.sources.files import inline_documents
from quern.streaming.events import framed

JSON, EVENTS = "application/json", "text/event-stream"
#: Characters that a question may have.
QUESTION_CHARS = 2_000


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def _body(raw: bytes, known: set[str]) -> dict:
    try:
        data = json.loads(raw)
    except ValueError as e:
        raise Refused(422, f"no JSON: {e}") from e
    if not isinstance(data, dict) or set(data) - known:
        raise Refused(422, f"give an object with some of {sorted(known)}")
    return data


def _question(raw: bytes) -> tuple[str, dict | None]:
    data = _body(raw, {"query", "filters"})
    query, filters = data.get("query"), data.get("filters") or {}
    if not isinstance(query, str) or not 1 <= len(query) <= QUESTION_CHARS:
        raise Refused(422, f"query must be a string of 1 to {QUESTION_CHARS} characters")
    if not isinstance(filters, dict) or not all(isinstance(v, (str, int, float, bool)) for v in filters.values()):
        raise Refused(422, "filters must map names to scalars")
    return query, filters or None


class Service:
    """``pipeline`` may be put in later; until then requests are answered with 503."""

    def __init__(self, pipeline: Pipeline | None):
        self.pipeline = pipeline

    def handle(self, method: str, path: str, raw: bytes = b"") -> tuple[int, str, Iterator[str]]:
        """(status, content type, body in pieces)."""
        routes: dict[tuple[str, str], Callable] = {("GET", "/health"): self._health, ("POST", "/index"): self._index, ("POST", "/query"): self._query, ("POST", "/query/stream"): self._stream}
        try:
            if path not in {p for _, p in routes}:
                raise Refused(404, "no such path")
            if (method, path) not in routes:
                raise Refused(405, "method not allowed")
            if self.pipeline is None:
                raise Refused(503, "pipeline is not initialised")
            kind, out = routes[method, path](raw)
            return 200, kind, out
        except Refused as e:
            return e.status, JSON, iter([json.dumps({"detail": e.detail})])
        except QuernError as e:
            return 400, JSON, iter([json.dumps({"detail": str(e)})])

    def _health(self, _: bytes):
        detail = self.pipeline.stats()
        return JSON, iter([json.dumps({"status": detail["status"], "detail": detail})])

    def _index(self, raw: bytes):
        data = _body(raw, {"documents"})
        documents = data.get("documents")
        if not isinstance(documents, list) or not all(isinstance(d, dict) for d in documents):
            raise Refused(422, "documents must be a list of objects")
        try:
            rows = inline_documents(self.pipeline.spark, documents)
        except StoreError as e:
            raise Refused(422, str(e)) from e
        report = self.pipeline.index(rows)
        return JSON, iter([json.dumps({"documents": report["documents"], "chunks": report["chunks"], "chunker": report["chunker"], "elapsed_ms": report["millis"]})])

    def _filtered(self, filters: dict | None) -> dict | None:
        """Filters on metadata that inline documents keep in a map."""
        rows = self.pipeline.chunks
        if filters is None or rows is None:
            return None
        inside = "metadata" in rows.columns
        return {(k if k in rows.columns or not inside else f"metadata.{k}"): (v if k in rows.columns or not inside or isinstance(v, str) else json.dumps(v)) for k, v in filters.items()}

    def _query(self, raw: bytes):
        query, filters = _question(raw)
        return JSON, iter([json.dumps(self.pipeline.query(query, self._filtered(filters)), ensure_ascii=False)])

    def _stream(self, raw: bytes):
        query, filters = _question(raw)
        return EVENTS, framed(self.pipeline.stream(query, self._filtered(filters)))

    def __call__(self, environ: dict, start_response: Callable) -> Iterator[bytes]:
        """The WSGI application."""
        size = int(environ.get("CONTENT_LENGTH") or 0)
        status, kind, out = self.handle(environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/"), environ["wsgi.input"].read(size) if size else b"")
        names = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 422: "Unprocessable Content", 503: "Service Unavailable"}
        start_response(f"{status} {names[status]}", [("Content-Type", kind), ("Cache-Control", "no-cache")])
        return (piece.encode() for piece in out)
