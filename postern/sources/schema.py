"""Index declarations and state schemas.

A state is a table with a key; some of its columns are declared as indexed, by hash (equality,
membership) or by range (equality and order).  A schema is validated when it is built, and has a
fingerprint by which registered schemas, tables and tokens recognise each other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.errors import SchemaError
from postern.functions.codecs import Codec, canonical_members, checked, codec_for
from postern.limits import TYPE_BYTES

HASH, RANGE = "hash", "range"


@dataclass(frozen=True)
class IndexDecl:
    """column is indexed by kind under name (the column's own by default).

    codec narrows a Spark type (say "byte" for a ShortType); labels name the values of an
    enumeration whose numbers are stored.
    """

    column: str
    kind: str = HASH
    name: str | None = None
    codec: str | None = None
    labels: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Index:
    """A validated declaration: scope is its identity within the state."""

    scope: str
    column: str
    kind: str
    codec: Codec
    membership: bool = False
    labels: dict[str, int] = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class StateSchema:
    state: str
    key: tuple[str, ...]
    struct: T.StructType = field(hash=False)
    decls: tuple[IndexDecl, ...] = ()

    def __post_init__(self) -> None:
        if not self.state:
            raise SchemaError("a state needs a name")
        if len(self.state.encode()) > TYPE_BYTES:
            raise SchemaError(f"the name of a state has at most {TYPE_BYTES} bytes")
        missing = [k for k in self.key if k not in self.struct.fieldNames()]
        if not self.key or missing:
            raise SchemaError(f"the key needs columns of the state; missing: {missing}")
        self.indexes  # noqa: B018  validates

    @classmethod
    def of(cls, state: str, key: str | tuple[str, ...], data: DataFrame | T.StructType, **kinds: str | IndexDecl) -> StateSchema:
        """Short form: columns by keyword, each "hash", "range" or a full declaration."""
        struct = data.schema if isinstance(data, DataFrame) else data
        decls = tuple(k if isinstance(k, IndexDecl) else IndexDecl(c, k) for c, k in kinds.items())
        return cls(state, (key,) if isinstance(key, str) else tuple(key), struct, decls)

    @cached_property
    def indexes(self) -> dict[str, Index]:
        """Indexes by the name that queries use."""
        out: dict[str, Index] = {}
        for d in self.decls:
            name = d.name or d.column
            if name in out:
                raise SchemaError(f"two indexes are named {name!r}")
            if d.kind not in (HASH, RANGE):
                raise SchemaError(f"an index is {HASH} or {RANGE}, not {d.kind!r}")
            if d.column not in self.struct.fieldNames():
                raise SchemaError(f"{self.state} has no column {d.column!r}")
            kind = self.struct[d.column].dataType
            membership = isinstance(kind, T.ArrayType)
            if membership and isinstance(kind.elementType, T.ArrayType):
                raise SchemaError("collections of collections cannot be indexed")
            codec = codec_for(kind.elementType if membership else kind, d.codec)
            if d.kind == RANGE and (membership or not codec.ranged):
                raise SchemaError(f"{d.column} cannot have a range index")
            if d.labels and not codec.integral:
                raise SchemaError("labels name integral values only")
            out[name] = Index(f"{self.state}/{name}", d.column, d.kind, codec, membership, dict(d.labels))
        return out

    @cached_property
    def fingerprint(self) -> bytes:
        """SHA-256 over the state, its key and its indexes in name order; fields are length-prefixed."""
        parts = [b"postern-schema-2" if any(i.membership for i in self.indexes.values()) else b"postern-schema-1", self.state.encode()]
        parts += [f"{k}:{self.struct[k].dataType.simpleString()}".encode() for k in self.key]
        for name in sorted(self.indexes):
            i = self.indexes[name]
            kind = i.codec.spark_type.simpleString()
            parts += [x.encode() for x in (name, i.column, i.kind, i.codec.name, kind, "members" if i.membership else "scalar")]
            parts += [f"{label}={value}".encode() for label, value in sorted(i.labels.items())]
        return hashlib.sha256(b"".join(len(p).to_bytes(4, "big") + p for p in parts)).digest()

    def key_columns(self) -> list[Column]:
        return [F.col(k) for k in self.key]

    def extract(self, df: DataFrame) -> DataFrame:
        """df with its indexed columns checked and canonicalised, as a write stores them."""
        changes = {i.column: canonical_members(F.col(i.column), i.codec) if i.membership else checked(F.col(i.column), i.codec) for i in self.indexes.values()}
        return df.withColumns(changes) if changes else df

    def projection(self, df: DataFrame) -> DataFrame:
        """Key and indexed columns only: what an index-only table keeps."""
        return df.select(*dict.fromkeys([*self.key, *(i.column for i in self.indexes.values())]))
