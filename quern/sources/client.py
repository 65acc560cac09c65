"""Client of a model server: tags, embeddings, chat and streamed chat, over any transport."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from quern.errors import ModelServerError

RETRIED = frozenset((408, 429, 500, 502, 503, 504))


def http(url: str, body: dict | None, timeout: float) -> tuple[int, Iterator[bytes]]:
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        reply = urllib.request.urlopen(request, timeout=timeout)
        return reply.status, iter(reply)
    except urllib.error.HTTPError as e:
        return e.code, iter(e)


class ModelClient:
    """``send(url, body, timeout) -> (status, lines)`` can be replaced, for tests or another transport."""

    def __init__(self, base: str, model: str, timeout: float = 60, attempts: int = 3, backoff: float = 0.5, send: Callable = http, sleep: Callable = time.sleep):
        self.base, self.model, self.timeout, self.attempts, self.backoff, self.send, self.sleep = base.rstrip("/"), model, timeout, attempts, backoff, send, sleep

    def _call(self, path: str, body: dict | None) -> dict:
        for n in range(self.attempts):
            try:
                status, lines = self.send(self.base + path, body, self.timeout)
                text = b"".join(lines)
                if status < 400:
                    return json.loads(text)
                if status not in RETRIED:
                    raise ModelServerError(f"{path}: status {status}")
                why = f"status {status}"
            except OSError as e:
                why = str(e)
            except ValueError as e:
                raise ModelServerError(f"{path}: no JSON: {e}") from e
            if n + 1 < self.attempts:
                self.sleep(self.backoff * 2**n)
        raise ModelServerError(f"{path}: {why} after {self.attempts} attempts")

    def models(self) -> list[str]:
        return [m["name"] for m in self._call("/api/tags", None).get("models", [])]

    def embed(self, texts: list[str]) -> list[list[float]]:
        found = self._call("/api/embed", {"model": self.model, "input": texts}).get("embeddings", [])
        if len(found) != len(texts):
            raise ModelServerError(f"{len(texts)} texts, {len(found)} vectors")
        return found

    def chat(self, messages: list[dict], schema: dict | None = None) -> str:
        return self._call("/api/chat", {"model": self.model, "messages": messages, "stream": False, "format": schema, "options": {"temperature": 0}})["message"]["content"]

    def stream(self, messages: list[dict], schema: dict | None = None) -> Iterator[str]:
        """Fragments as they come; never tried twice."""
        status, lines = self.send(self.base + "/api/chat", {"model": self.model, "messages": messages, "stream": True, "format": schema}, self.timeout)
        if status >= 400:
            raise ModelServerError(f"/api/chat: status {status}")
        for line in lines:
            if line.strip():
                part = json.loads(line)
                if text := part.get("message", {}).get("content"):
                    yield text
                if part.get("done"):
                    return
