"""Plans as Spark columns and DataFrames.

A leaf becomes one comparison of the bare column with a literal of its own type, which Parquet can
push down; a membership becomes array_contains over canonical arrays, which hold no nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.plans.literals import as_literal
from postern.plans.nodes import All, And, Empty, Exact, OneOf, Or, Plan, Range, balanced


def to_column(plan: Plan) -> Column:
    match plan:
        case All():
            return F.lit(True)
        case Empty():
            return F.lit(False)
        case Exact(index, value) if index.membership:
            return F.array_contains(F.col(index.column), as_literal(index, value))
        case Exact(index, value):
            return F.col(index.column) == as_literal(index, value)
        case OneOf(index, values):
            return F.col(index.column).isin(*(as_literal(index, v) for v in values))
        case Range(index, low, low_in, high, high_in):
            column, ends = F.col(index.column), []
            if low is not None:
                ends.append(column >= as_literal(index, low) if low_in else column > as_literal(index, low))
            if high is not None:
                ends.append(column <= as_literal(index, high, True) if high_in else column < as_literal(index, high, True))
            return balanced(ends or [column.isNotNull()], lambda a, b: a & b)
        case And(parts):
            return balanced([to_column(p) for p in parts], lambda a, b: a & b)
        case Or(parts):
            return balanced([to_column(p) for p in parts], lambda a, b: a | b)
    raise TypeError(plan)


def _floats_without_upper_end(plan: Plan) -> set[str]:
    """Float columns for which a comparison alone would also take NaN, which Spark sorts above all numbers."""
    if isinstance(plan, And | Or):
        return set().union(*(_floats_without_upper_end(p) for p in plan.parts))
    return {plan.index.column} if isinstance(plan, Range) and plan.index.codec.family == "float" and plan.high is None else set()


def apply(df: DataFrame, plan: Plan, managed: bool = True) -> DataFrame:
    """The rows of df that the plan selects; an empty plan scans nothing.

    Managed tables hold no NaN.  Other data may, and NaN satisfies no comparison.
    """
    if isinstance(plan, All):
        return df
    if isinstance(plan, Empty):
        return df.limit(0)
    condition = to_column(plan)
    if not managed:
        condition = _without_nan(plan)
    return df.where(condition)


def _without_nan(plan: Plan) -> Column:
    if isinstance(plan, And | Or):
        join = (lambda a, b: a & b) if isinstance(plan, And) else (lambda a, b: a | b)
        return balanced([_without_nan(p) for p in plan.parts], join)
    column = to_column(plan)
    for name in _floats_without_upper_end(plan):
        column = column & ~F.isnan(F.col(name))
    return column
