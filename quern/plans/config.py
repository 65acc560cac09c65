"""Configuration: nested, frozen, unknown keys refused, ${VAR} and ${VAR:default} expanded."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass

from quern.errors import ConfigError

_VAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")


# Section and key names and their defaults.


@dataclass(frozen=True)
class Chunking:
    strategy: str = "structural"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Embedding:
    provider: str = "hashing"
    dim: int = 512
    seed: int = 20260214
    batch_size: int = 32


@dataclass(frozen=True)
class Store:
    metric: str = "cosine"
    path: str = ""


@dataclass(frozen=True)
class Lexical:
    enabled: bool = True
    k1: float = 1.5
    b: float = 0.75
    min_token_length: int = 2
    use_stemming: bool = True


@dataclass(frozen=True)
class Retrieval:
    dense_k: int = 30
    lexical_k: int = 30
    final_k: int = 6


@dataclass(frozen=True)
class Fusion:
    method: str = "rrf"
    k: int = 60
    weights: dict = field(default_factory=lambda: {"dense": 0.5, "lexical": 0.5})


@dataclass(frozen=True)
class Rerank:
    provider: str = "none"
    top_n: int = 20


@dataclass(frozen=True)
class Generation:
    provider: str = "extractive"
    max_context_chars: int = 6000
    max_chunk_chars: int = 1500
    max_sentences: int = 3
    min_support: float = 0.0


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    store: Store = field(default_factory=Store)
    lexical: Lexical = field(default_factory=Lexical)
    retrieval: Retrieval = field(default_factory=Retrieval)
    fusion: Fusion = field(default_factory=Fusion)
    rerank: Rerank = field(default_factory=Rerank)
    generation: Generation = field(default_factory=Generation)

    def __post_init__(self):
        r = self.retrieval
        checks = (
            (self.embedding.dim > 0 and self.embedding.batch_size > 0, "embedding.dim and embedding.batch_size must be positive"),
            (self.lexical.k1 >= 0 and 0 <= self.lexical.b <= 1, "lexical.k1 must not be negative, lexical.b between 0 and 1"),
            (self.lexical.min_token_length >= 1, "lexical.min_token_length must be positive"),
            (self.fusion.k > 0 and all(w >= 0 for w in self.fusion.weights.values()), "fusion.k must be positive, fusion.weights not negative"),
            (min(self.generation.max_context_chars, self.generation.max_chunk_chars, self.generation.max_sentences) > 0, "generation sizes must be positive"),
            (0 <= self.generation.min_support <= 1, "generation.min_support must be between 0 and 1"),
            (self.rerank.top_n > 0, "rerank.top_n must be positive"),
        )
        for fine, why in checks:
            if not fine:
                raise ConfigError(why)
        if min(r.dense_k, r.lexical_k) < 0 or r.final_k <= 0:
            raise ConfigError("retrieval sizes must not be negative, final_k positive")
        if not r.dense_k and not (self.lexical.enabled and r.lexical_k):
            raise ConfigError("dense and lexical retrieval are both off")
        if self.rerank.provider != "none" and self.rerank.top_n < r.final_k:
            raise ConfigError("rerank.top_n must be at least retrieval.final_k")
        for value, known in ((self.rerank.provider, ("none", "heuristic", "judge")), (self.embedding.provider, ("hashing", "blake2b", "remote")), (self.generation.provider, ("extractive", "model")), (self.store.metric, ("cosine", "l2")), (self.fusion.method, ("rrf", "weighted")), (self.chunking.strategy, ("fixed", "sentence", "structural", "token"))):
            if value not in known:
                raise ConfigError(f"{value!r} is none of {known}")


def expand(value):
    """``value`` with variables of the environment put in, inside lists and maps too."""
    if isinstance(value, str):

        def put(m: re.Match) -> str:
            found = os.environ.get(m[1], m[2])
            if found is None:
                raise ConfigError(f"variable {m[1]} is not set")
            return found

        return _VAR.sub(put, value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def build(given: dict, kind: type = Config):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(given) - set(known):
        raise ConfigError(f"unknown keys in {kind.__name__}: {sorted(unknown)}")
    parts = {}
    for name, value in given.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        parts[name] = build(value, type(default)) if is_dataclass(default) else value
    return kind(**parts)


def load(given: dict) -> Config:
    return build(expand(given))


def variant(given: dict, **sections: dict) -> Config:
    """``given`` with some sections' keys replaced, for sweeps."""
    return load({**given, **{name: {**given.get(name, {}), **keys} for name, keys in sections.items()}})
