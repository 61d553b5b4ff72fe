"""Current state from events: dedup, staleness, latest records, pairs, lifecycle.

Batch forms are aggregates and windows over (account, generation).  reduce_mutations() is the exact
fold where one event's fate depends on those before it: rows are dealt and sorted by account, and a
task folds them as they stream by, holding the records of one account at a time.  That order is part of its
meaning, so one account is one task's work, however many events it has, and what an account has processed is
remembered until its generation ends; use the batch forms where an account may be too large for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What can become of a mutation.
APPLIED, DUPLICATE, STALE, CONFLICT, MISSING, INACTIVE = "Applied", "Duplicate", "IgnoredStale", "ConflictingRevision", "MissingPriorRecord", "InactiveAccountMutation"


def dedup(events: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The first arrival of each identity.  An aggregate, so repeats combine before the shuffle."""
    rest = [c for c in events.columns if c not in identity]
    first = events.groupBy(*identity).agg(F.min_by(F.struct(*rest), order).alias("first"))
    return first.select(*identity, "first.*").select(*events.columns)


def reject_stale(events: DataFrame, key: list[str], revision: str, order: str) -> DataFrame:
    """events with `fate`: stale below the greatest revision seen before, a conflict at it."""
    before = F.max(revision).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("fate", F.when(F.col(revision) < before, STALE).when(F.col(revision) == before, CONFLICT).otherwise(APPLIED))


def latest_records(events: DataFrame, address: list[str], revision: str, action: str = "action", tie: str | None = None) -> DataFrame:
    """The record of each address at its greatest revision, unless that deleted it."""
    rest = [c for c in events.columns if c not in address]
    by = F.struct(revision, tie) if tie else F.col(revision)
    last = events.groupBy(*address).agg(F.max_by(F.struct(*rest), by).alias("last"))
    return last.select(*address, "last.*").where(F.col(action) != "delete").select(*events.columns)


def pair_counts(records: DataFrame, source: str, target: str) -> DataFrame:
    """source and n: its distinct targets; a pair counts once however many records hold it."""
    pairs = records.groupBy(source, target).agg(F.count("*").alias("multiplicity")).where(F.col(target).isNotNull())
    return pairs.groupBy(source).agg(F.count("*").alias("n"))


def last_activity(events: DataFrame, key: str, minute: Column) -> DataFrame:
    return events.groupBy(key).agg(F.max(minute).alias("last_activity"))


def received(events: DataFrame, kinds: list[str], source: str, target: str, kind: str) -> DataFrame:
    """Events of the given kinds, keyed by their target: what it received."""
    return events.where(F.col(kind).isin(*kinds) & F.col(target).isNotNull()).drop(source).withColumnRenamed(target, source)


def generations(lifecycle: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """generation, status and since of each key: a deactivation purges, and begins the next generation."""
    w = Window.partitionBy(key).orderBy(order)
    changes = lifecycle.withColumn("__before", F.coalesce(F.lag(status).over(w), F.lit("active"))).where(F.col("__before") != F.col(status))
    ended = F.when(F.col(status) != "active", 1)
    return changes.groupBy(key).agg(F.count(ended).alias("generation"), F.max_by(status, order).alias("status"), F.max(F.when(F.col(status) != "active", F.col(order))).alias("since"))


def purge(events: DataFrame, lifecycles: DataFrame, key: str, order: str) -> DataFrame:
    """Events of the current generation of active keys, with their generation."""
    known = lifecycles.select(F.col(key).alias("__key"), "generation", "status", "since")
    joined = events.join(known, events[key] == F.col("__key"), "left")
    alive = F.coalesce(F.col("status") == "active", F.lit(True)) & F.coalesce(F.col(order) > F.col("since"), F.lit(True))
    return joined.where(alive).withColumn("generation", F.coalesce("generation", F.lit(0))).select(*events.columns, "generation")


def latest_status(observations: DataFrame, key: str, status: str, ordinal: str, keep: str = "active") -> DataFrame:
    """Keys whose last observation says `keep`."""
    return observations.groupBy(key).agg(F.max_by(status, ordinal).alias(status)).where(F.col(status) == keep).select(key)


def admitted(allowlist: DataFrame, key: str, cap: int) -> DataFrame:
    """The first `cap` keys of the sorted allowlist."""
    return allowlist.select(key).distinct().orderBy(key).limit(cap)


def admit(rows: DataFrame, allowlist: DataFrame, key: str, cap: int) -> DataFrame:
    return rows.join(admitted(allowlist, key, cap), key, "left_semi")


def external_sort(rows: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows in one total order, over as many files: range exchange, then sorts that spill by themselves."""
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


@dataclass
class Repository:
    """What the fold knows of one account."""

    status: str = "active"
    generation: int = 0
    last_revision: str | None = None
    records: dict[tuple[str, str], str] = field(default_factory=dict)
    processed: set[tuple[int, str]] = field(default_factory=set)

    def lifecycle(self, status: str) -> str:
        if status == self.status:
            return DUPLICATE
        if status != "active":
            self.generation += 1
            self.last_revision = None
            self.records.clear()
        self.status = status
        return APPLIED

    def mutation(self, semantic_key: str, revision: str, collection: str, record_key: str, action: str) -> str:
        """Stale events count as processed, quarantined ones do not: they are looked at anew when retried."""
        event = (self.generation, semantic_key)
        if event in self.processed:
            return DUPLICATE
        if self.status != "active":
            return INACTIVE
        existing = self.records.get((collection, record_key))
        if (self.last_revision is not None and revision < self.last_revision) or (existing is not None and revision < existing):
            self.processed.add(event)
            return STALE
        if existing is not None and revision == existing:
            return CONFLICT
        if action == "delete":
            if existing is None:
                return MISSING
            del self.records[collection, record_key]
        else:
            self.records[collection, record_key] = revision
        self.last_revision = max(self.last_revision or revision, revision)
        self.processed.add(event)
        return APPLIED


def reduce_mutations(events: DataFrame, order: str = "seq") -> DataFrame:
    """events (columns of the parser, and an order) with `fate` and `generation`."""
    struct = T.StructType([*events.schema.fields, T.StructField("fate", T.StringType()), T.StructField("generation", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        did, own = None, Repository()
        for batch in batches:
            fates, generations_ = [], []
            for r in batch.select(["did", "event", "status", "semantic_key", "revision", "collection", "record_key", "action"]).to_pylist():
                if r["did"] != did:
                    did, own = r["did"], Repository()
                if r["event"] == "identity":
                    fates.append(own.lifecycle(r["status"]))
                elif r["event"] == "record":
                    fates.append(own.mutation(r["semantic_key"], r["revision"], r["collection"], r["record_key"], r["action"]))
                else:
                    fates.append(APPLIED)
                generations_.append(own.generation)
            yield batch.append_column("fate", pa.array(fates, pa.string())).append_column("generation", pa.array(generations_, pa.int64()))

    return events.repartition("did").sortWithinPartitions("did", order).mapInArrow(run, struct)
