"""The searchable projection of accounts: 17 numbers, their default predicate, and range queries on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.plans.predicate import P, Predicate
from postern.sources.schema import RANGE, IndexDecl, StateSchema

# The numbers, in their order.
FIELDS = (
    "last_activity",
    "created_1d",
    "created_7d",
    "created_30d",
    "updated_1d",
    "updated_7d",
    "updated_30d",
    "deleted_1d",
    "deleted_7d",
    "deleted_30d",
    "posts",
    "following",
    "followers",
    "post_creates_1d",
    "post_creates_7d",
    "post_creates_30d",
    "engagement_30d",
)


def complete(df: DataFrame, key: str) -> DataFrame:
    """df with all 17 numbers as longs; those it lacks are 0."""
    have = set(df.columns)
    return df.select(key, *((F.coalesce(F.col(f).cast("long"), F.lit(0)) if f in have else F.lit(0).cast("long")).alias(f) for f in FIELDS))


def schema(df: DataFrame, key: str, state: str = "account") -> StateSchema:
    return StateSchema(state, (key,), df.schema, tuple(IndexDecl(f, RANGE) for f in FIELDS))


def between(**ends: tuple[int | None, int | None]) -> list[Predicate]:
    """One predicate for every end given, inclusive; without any, all accounts that were ever active."""
    out = []
    for name, (low, high) in ends.items():
        out += [P(name) >= low] * (low is not None) + [P(name) <= high] * (high is not None)
    return out or [P("last_activity") >= 0]
