"""The same operators over Structured Streaming sources.

State is bounded by watermarks: dedup forgets identities, and buckets close, once they are late.
Sinks are keyed tables, written once per micro-batch; a repeated micro-batch finds its mark in the
table's manifest and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from postern.errors import ConcurrentWriteError
from postern.sources.table import Table
from postern.streaming.windows import next_expiry, recalculated


def deduplicated(events: DataFrame, ts: str, identity: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(identity)


def minute_buckets(events: DataFrame, ts: str, key: list[str], counters: dict[str, object], late: str | None = "10 minutes") -> DataFrame:
    """Closed minutes: key, minute and counts, emitted once no event of the minute can come any more.

    late is None for events that have a watermark already.
    """
    counted = [F.sum(F.when(condition, 1).otherwise(0)).alias(name) for name, condition in counters.items()]
    marked = events if late is None else events.withWatermark(ts, late)
    grouped = marked.groupBy(*key, F.window(ts, "1 minute").alias("w")).agg(*counted)
    minute = F.floor(F.unix_micros(F.col("w.start").cast("timestamp")) / 60_000_000).cast("long")
    return grouped.select(*key, minute.alias("minute"), *counters)


def once(table: Table, source: str, write: Callable[[DataFrame, tuple[str, int]], object]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies each batch of a source once, also when Spark repeats it.

    The batch's number is committed by the same manifest as its rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        if table.marked(source) < number:
            write(batch, (source, number))

    return each


def into_table(changes: DataFrame, table: Table, source: str, checkpoint: str, op: str = "op", order: str = "version") -> DataStreamWriter:
    """Per key the newest change of each micro-batch becomes a blind upsert or removal."""
    write = once(table, source, lambda batch, mark: table.apply_outbox(batch, op, order, mark))
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def add_buckets(buckets: DataFrame, table: Table, source: str, checkpoint: str) -> DataStreamWriter:
    """Adds closed minutes to a table of buckets; a minute that is there already grows.

    Of the table only the minutes between the batch's first and last are read, by a filter on its files.
    """
    key = list(table.schema.key)

    def write(batch: DataFrame, mark: tuple[str, int]) -> None:
        counters = [c for c in batch.columns if c not in key]
        first, last = batch.agg(F.min("minute"), F.max("minute")).first()
        while True:
            version = table.manifest()
            known = table.current(version).where(F.col("minute").between(first, last))
            before = known.select(*key, *counters).join(batch.select(*key), key, "left_semi")
            try:
                table.follow(version, batch.unionByName(before).groupBy(*key).agg(*(F.sum(c).alias(c) for c in counters)), mark)
                return
            except ConcurrentWriteError:
                continue  # another writer's counts are added to, not overwritten

    return buckets.writeStream.foreachBatch(once(table, source, write)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def recalculate(accounts: Table, bucketed: DataFrame, now: int, counters: list[str], counted: Column, engaged: Column) -> str:
    """Brings the accounts whose next_expiry has come up to `now`: their trailing counts, and their next expiry.

    One blind write; accounts that a later event has moved on since are due again, not wrong.  Returns the
    table's version.
    """
    key, names = list(accounts.schema.key), accounts.columns.fieldNames()
    state = accounts.current()
    due = state.where(F.col("next_expiry") <= now)
    counts = recalculated(due, bucketed, key, now, counters)
    after = next_expiry(bucketed.join(due.select(*key), key, "left_semi"), key, now, counted, engaged)
    kept = due.select(*(c for c in names if c in key or (c != "next_expiry" and c not in counts.columns)))
    rows = kept.join(counts, key).join(after, key, "left")
    return accounts.upsert(rows.select(*(F.col(c).cast(accounts.columns[c].dataType).alias(c) for c in names)))


def keep_recalculated(accounts: Table, step: Callable[[int], object], clock: Callable[[], int], wait: Callable[[int | None], bool]) -> int:
    """Calls step(now) whenever some account is due, until wait() says so; returns how often.

    wait gets the least next_expiry, or None if there is none, and returns whether to go on: a timer on a
    cluster, a list of times in tests.  Times that were missed, say while no driver ran, are made up in one step.
    """
    steps = 0
    while True:
        first = accounts.current().agg(F.min("next_expiry")).first()[0]
        if first is not None and first <= clock():
            step(clock())
            steps += 1
        elif not wait(first):
            return steps
