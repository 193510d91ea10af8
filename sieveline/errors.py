"""Errors raised on the driver, while a plan is built wherever that is possible."""


class SievelineError(Exception):
    """Base of every error of this package."""


class SchemaError(SievelineError):
    """A schema or a configuration is not usable."""


class InvalidQuery(SievelineError):
    """A query or a filter can not be evaluated as written."""


class UnknownField(SievelineError):
    """A field is not part of the schema."""


class DimensionMismatch(SievelineError):
    """A vector has another width than the index."""


class NotFound(SievelineError):
    """Something that should be there is not."""


class ModelError(SievelineError):
    """An embedder or a re-ranker broke its contract."""


class Corrupt(SievelineError):
    """Stored parts contradict each other."""


class FingerprintMismatch(SievelineError):
    """An index was made by another embedder."""


class BudgetExhausted(SievelineError):
    """A strict search ran out of its budget."""


class IndexIoError(SievelineError):
    """A write on a read-only handle, or a stale writer."""


class BackendError(SievelineError):
    """The engine below failed."""
