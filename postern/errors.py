"""Exceptions of the engine; each says which contract was broken."""


class PosternError(Exception):
    """Base of all engine errors."""


class UnsupportedQueryError(PosternError, NotImplementedError):
    """The predicate or operation is outside the closed query surface."""


class InvalidArgumentError(PosternError, ValueError):
    """An argument breaks a stated rule."""


class ArgumentRangeError(InvalidArgumentError):
    """A number lies outside its stated limits."""


class QueryLimitError(PosternError):
    """A complete answer would exceed a ceiling; nothing is truncated instead."""


class InvalidContinuationError(PosternError):
    """A token is malformed, forged, or made under a key that is no longer known."""


class StaleContinuationError(PosternError):
    """A token is genuine but belongs to another query, schema, layout or policy."""


class ConcurrentWriteError(PosternError):
    """The version that a write expected is not the current one."""


class SchemaError(PosternError):
    """An index schema is invalid, unregistered or not active."""


class StorageError(PosternError):
    """Stored files do not form a valid table."""


class CapacityError(PosternError):
    """A record exceeds a capacity limit."""
