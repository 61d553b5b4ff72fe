"""Codecs: what an indexed column holds, how values compare, and how they are canonicalised.

A codec ties a Spark type to a closed domain.  Write-side expressions are built from built-in
functions only, so ingest stays inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.errors import SchemaError
from postern.limits import ENTRIES_PER_INDEX


@dataclass(frozen=True)
class Codec:
    """family: text, char, integral, decimal, float, time, guid or bool; domain bounds integral values."""

    name: str
    family: str
    spark_type: T.DataType
    low: int | None = None
    high: int | None = None
    ranged: bool = True

    @property
    def integral(self) -> bool:
        return self.family in ("integral", "char")


def _integral(name: str, kind: T.DataType, bits: int, signed: bool) -> Codec:
    low = -(1 << bits - 1) if signed else 0
    return Codec(name, "integral", kind, low, low + (1 << bits) - 1)


_ALL = (
    Codec("string", "text", T.StringType()),
    Codec("char", "char", T.StringType(), 0, 0xFFFF),
    _integral("sbyte", T.ByteType(), 8, True),
    _integral("short", T.ShortType(), 16, True),
    _integral("int", T.IntegerType(), 32, True),
    _integral("long", T.LongType(), 64, True),
    _integral("byte", T.ShortType(), 8, False),
    _integral("ushort", T.IntegerType(), 16, False),
    _integral("uint", T.LongType(), 32, False),
    _integral("ulong", T.DecimalType(20, 0), 64, False),
    Codec("decimal", "decimal", T.DecimalType(38, 18)),
    Codec("float", "float", T.FloatType()),
    Codec("double", "float", T.DoubleType()),
    Codec("timestamp", "time", T.TimestampType()),
    Codec("timestamp_ntz", "time", T.TimestampNTZType()),
    Codec("guid", "guid", T.StringType(), ranged=False),
    Codec("bool", "bool", T.BooleanType(), ranged=False),
)
CODECS = {c.name: c for c in _ALL}

_DEFAULTS = {
    T.StringType: "string",
    T.ByteType: "sbyte",
    T.ShortType: "short",
    T.IntegerType: "int",
    T.LongType: "long",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.TimestampType: "timestamp",
    T.TimestampNTZType: "timestamp_ntz",
    T.BooleanType: "bool",
}


def codec_for(kind: T.DataType, name: str | None = None) -> Codec:
    """The named codec, or the natural one of a Spark type; the two must agree."""
    if isinstance(kind, T.DecimalType) and name in (None, "decimal"):
        return Codec("decimal", "decimal", kind)
    if name is None:
        name = next((n for t, n in _DEFAULTS.items() if type(kind) is t), None)
        if name is None:
            raise SchemaError(f"columns of type {kind.simpleString()} cannot be indexed")
    if name not in CODECS:
        raise SchemaError(f"there is no codec {name!r}")
    codec = CODECS[name]
    if type(codec.spark_type) is not type(kind) or (name == "ulong" and codec.spark_type != kind):
        raise SchemaError(f"codec {name} stores {codec.spark_type.simpleString()}, not {kind.simpleString()}")
    return codec


def violation(column: Column, codec: Codec) -> Column:
    """A message if the value is outside of the codec's domain, else null.  Null values are fine."""
    if codec.family == "float":
        return F.when(F.isnan(column), F.lit("NaN cannot be indexed"))
    if codec.family == "char":
        return F.when(F.length(column) != 1, F.lit("a char is one character"))
    if codec.family == "guid":
        return F.when(~column.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit("not a canonical GUID"))
    if codec.family == "integral" and type(codec.spark_type) in (T.ShortType, T.IntegerType, T.LongType, T.DecimalType):
        low, high = F.lit(codec.low).cast(codec.spark_type), F.lit(codec.high).cast(codec.spark_type)
        return F.when((column < low) | (column > high), F.lit(f"outside of the domain of {codec.name}"))
    return F.lit(None).cast("string")


def canonical_scalar(column: Column, codec: Codec) -> Column:
    """-0.0 becomes 0.0; GUIDs are lower-cased; all else stays."""
    if codec.family == "float":
        return F.when(column == 0, F.lit(0.0).cast(codec.spark_type)).otherwise(column)
    if codec.family == "guid":
        return F.lower(column)
    return column


def canonical_members(column: Column, codec: Codec) -> Column:
    """A collection as a sorted set without nulls; null collections are empty.

    More than the allowed number of distinct members stops the write; repeats do not count.
    """
    present = F.filter(F.coalesce(column, F.array().cast(T.ArrayType(codec.spark_type))), lambda x: x.isNotNull())
    members = F.array_sort(F.array_distinct(F.transform(present, lambda x: canonical_scalar(x, codec))))
    fits = F.size(members) <= ENTRIES_PER_INDEX
    return F.when(fits, members).otherwise(F.raise_error(F.lit(f"a collection holds more than {ENTRIES_PER_INDEX} distinct members")).cast(T.ArrayType(codec.spark_type)))


def checked(column: Column, codec: Codec) -> Column:
    """The canonical value; values outside of the codec's domain stop the write."""
    value = canonical_scalar(column, codec)
    problem = violation(value, codec)
    return F.when(problem.isNull(), value).otherwise(F.raise_error(problem).cast(codec.spark_type))
