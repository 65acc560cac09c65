"""Errors raised on the driver while a plan is built."""


class QuernError(Exception):
    pass


class ChunkingError(QuernError):
    pass


class EmbeddingError(QuernError):
    pass


class DimensionMismatchError(EmbeddingError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected vectors of {expected} dimensions, got {actual}")
        self.expected, self.actual = expected, actual


class StoreError(QuernError):
    pass


class FusionError(QuernError):
    pass


class ConfigError(QuernError):
    pass


class ModelServerError(QuernError):
    pass
