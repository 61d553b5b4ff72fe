"""Operands brought into the domain of their column.

An operand is compared as the mathematical number it is.  For a column over a domain, the set
{x in the domain : x op operand} is an interval, a value, or nothing; its ends are values of the
column's own type.  So Spark sees literals of the column's type, adds no cast around the column,
and pushes the filter down to the files.
"""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import math
import uuid
from decimal import Decimal
from fractions import Fraction
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.errors import InvalidArgumentError, UnsupportedQueryError
from postern.plans.nodes import Empty, Exact, Plan, Range, closed
from postern.sources.schema import RANGE, Index

#: Integers up to here are exact in doubles, and in floats.
EXACT_DOUBLE, EXACT_FLOAT = 2**53, 2**24

_OPS = ("==", "<", "<=", ">", ">=")


def leaf(index: Index, op: str, operand: Any) -> Plan:
    """The plan of `column op operand`."""
    if operand is None:
        raise UnsupportedQueryError("comparisons with null are not supported")
    if op not in _OPS:
        raise UnsupportedQueryError(f"operator {op} is not supported")
    if index.membership:
        raise UnsupportedQueryError("collections are queried by contains() only")
    if op != "==" and index.kind != RANGE:
        raise UnsupportedQueryError(f"{index.column} has a hash index, which answers equality only")
    return _bounded(index, op, operand)


def member(index: Index, operand: Any) -> Plan:
    if operand is None:
        raise UnsupportedQueryError("membership of null is not supported")
    if not index.membership:
        raise UnsupportedQueryError(f"{index.column} is not a collection")
    return _bounded(index, "==", operand)


def _bounded(index: Index, op: str, operand: Any) -> Plan:
    family = index.codec.family
    if family in ("integral", "char"):
        return _integral(index, op, _number(index, operand))
    if family == "float":
        return _float(index, op, operand)
    if family == "decimal":
        return _decimal(index, op, operand)
    return _interval(index, op, typed(index, operand))


def _interval(index: Index, op: str, value: Any) -> Plan:
    if op == "==":
        return Exact(index, value)
    if op in (">", ">="):
        return Range(index, low=value, low_in=op == ">=")
    return Range(index, high=value, high_in=op == "<=")


def _number(index: Index, operand: Any) -> int | Fraction | float:
    """The operand as an exact number; infinities and NaN stay floats."""
    if isinstance(operand, enum.Enum):
        operand = operand.value
    if isinstance(operand, str) and operand in index.labels:
        return index.labels[operand]
    if index.codec.family == "char" and isinstance(operand, str) and len(operand) == 1:
        return ord(operand)
    if isinstance(operand, np.generic):
        if isinstance(operand, np.float32) and max(abs(index.codec.low), index.codec.high) > EXACT_FLOAT:
            raise UnsupportedQueryError(f"{index.column} holds integers that a float cannot tell apart")
        operand = operand.item()
    if isinstance(operand, bool) or not isinstance(operand, int | float | Decimal | Fraction):
        raise UnsupportedQueryError(f"{index.column} cannot be compared with a {type(operand).__name__}")
    if isinstance(operand, float) and max(abs(index.codec.low), index.codec.high) > EXACT_DOUBLE:
        raise UnsupportedQueryError(f"{index.column} holds integers that a double cannot tell apart")
    if isinstance(operand, float | Decimal) and not math.isfinite(operand):
        return float(operand)
    return operand if isinstance(operand, int) else Fraction(operand)


def _integral(index: Index, op: str, v: int | Fraction | float) -> Plan:
    low, high = index.codec.low, index.codec.high
    if isinstance(v, float):
        if math.isnan(v):
            return Empty()
        v = high + 1 if v > 0 else low - 1
    if op == "==":
        return Exact(index, int(v)) if v == int(v) and low <= v <= high else Empty()
    if op in (">", ">="):
        first = math.floor(v) + 1 if op == ">" else math.ceil(v)
        return Empty() if first > high else closed(Range(index, low=max(first, low)))
    last = math.ceil(v) - 1 if op == "<" else math.floor(v)
    return Empty() if last < low else closed(Range(index, high=min(last, high)))


def _float(index: Index, op: str, operand: Any) -> Plan:
    if isinstance(operand, np.floating):
        operand = operand.item()
    if isinstance(operand, int) and not isinstance(operand, bool) and abs(operand) <= EXACT_DOUBLE:
        operand = float(operand)
    if not isinstance(operand, float):
        raise UnsupportedQueryError(f"{index.column} is compared with floats only, not with a {type(operand).__name__}")
    if math.isnan(operand):
        return Empty()
    if isinstance(index.codec.spark_type, T.DoubleType):
        return _interval(index, op, operand + 0.0)
    with np.errstate(over="ignore"):
        near = np.float32(operand)
    if float(near) == operand:
        return _interval(index, op, float(near) + 0.0)
    if op == "==":
        return Empty()
    # The operand lies between two floats; every order means all floats on one side of it.
    if op in (">", ">="):
        first = near if float(near) > operand else np.nextafter(near, np.float32(np.inf))
        return Range(index, low=float(first))
    last = near if float(near) < operand else np.nextafter(near, np.float32(-np.inf))
    return Range(index, high=float(last))


def _decimal(index: Index, op: str, operand: Any) -> Plan:
    if isinstance(operand, int) and not isinstance(operand, bool):
        operand = Decimal(operand)
    if not isinstance(operand, Decimal):
        raise UnsupportedQueryError(f"{index.column} is compared with decimals only, not with a {type(operand).__name__}")
    if operand.is_nan():
        return Empty()
    kind = index.codec.spark_type
    step = Decimal(1).scaleb(-kind.scale)
    with decimal.localcontext() as exact:
        exact.prec = 120
        top = Decimal(10) ** (kind.precision - kind.scale) - step
        if abs(operand) > top:
            if op == "==" or (operand > 0) == (op in (">", ">=")):
                return Empty()
            return Range(index, high=top) if operand > 0 else Range(index, low=-top)
        down = operand.quantize(step, rounding=decimal.ROUND_FLOOR)
        if down == operand:
            return _interval(index, op, down)
        if op == "==":
            return Empty()
        return Range(index, low=down + step) if op in (">", ">=") else Range(index, high=down)


def typed(index: Index, operand: Any) -> Any:
    """An operand that must already have the column's own type."""
    family = index.codec.family
    if family == "text" and isinstance(operand, str):
        return operand
    if family == "bool" and isinstance(operand, bool):
        return operand
    if family == "guid" and isinstance(operand, uuid.UUID | str):
        try:
            return str(operand if isinstance(operand, uuid.UUID) else uuid.UUID(operand))
        except ValueError:
            raise InvalidArgumentError(f"{operand!r} is not a GUID") from None
    if family == "time" and isinstance(operand, dt.datetime):
        if isinstance(index.codec.spark_type, T.TimestampNTZType):
            if operand.tzinfo is not None:
                raise InvalidArgumentError(f"{index.column} has no time zone; neither may its operands")
            return operand
        if operand.tzinfo is None:
            raise InvalidArgumentError(f"{index.column} is compared with UTC times; this one has no time zone")
        return operand.astimezone(dt.UTC)
    raise UnsupportedQueryError(f"{index.column} cannot be compared with a {type(operand).__name__}")


_SURROGATES = range(0xD800, 0xE000)


def as_literal(index: Index, value: Any, upper: bool = False) -> Column:
    """value as a literal of the column's own type."""
    kind = index.codec.spark_type
    if index.codec.family == "char":
        if value in _SURROGATES:  # no text holds one
            value = 0xD7FF if upper else 0xE000
        return F.lit(chr(value))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(round(value.timestamp() * 1_000_000)))
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    if isinstance(kind, T.DecimalType):
        return F.lit(format(Decimal(value), "f")).cast(kind)
    return F.lit(value).cast(kind)
