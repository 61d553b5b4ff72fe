"""Hydration: full records for a page of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.plans import nodes
from postern.plans.compile import apply


def left(ids: DataFrame, records: DataFrame, key: tuple[str, ...] | list[str]) -> DataFrame:
    """Every key with its record; records that vanished since give nulls, told apart by `found`."""
    return ids.select(*key).join(records.withColumn("found", F.lit(True)), list(key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recheck(ids: DataFrame, records: DataFrame, key: tuple[str, ...] | list[str], plan: nodes.Plan, managed: bool = False) -> DataFrame:
    """The records of the keys that still exist and still match.

    The predicate is applied to the records before the join, where it reaches the files.  managed says that
    the records come from a table of a namespace, whose writes let no NaN in; of others NaN matches nothing.
    """
    return apply(records, plan, managed).join(ids.select(*key).distinct(), list(key), "left_semi")
