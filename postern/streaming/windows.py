"""Minute buckets, trailing counts over 1, 7 and 30 days, their expiry, and retention.

Minutes count from the epoch.  A trailing window at a cut is (cut - length, cut].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.errors import ConcurrentWriteError, InvalidArgumentError
from postern.sources.files import Files

# Window lengths in minutes.
WINDOWS = {"1d": 1440, "7d": 10080, "30d": 43200}


def minute_of(ts: str | Column) -> Column:
    """Whole minutes since the epoch of a timestamp, with or without time zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(column.cast("timestamp")) / 60_000_000).cast("long")


def buckets(events: DataFrame, key: list[str], minute: Column, counters: dict[str, Column]) -> DataFrame:
    """key, minute and one additive count per counter (a condition) of every minute that has events."""
    counted = {name: F.sum(F.when(condition, 1).otherwise(0)).alias(name) for name, condition in counters.items()}
    return events.groupBy(*key, minute.alias("minute")).agg(*counted.values())


def merged(*parts: DataFrame, key: list[str]) -> DataFrame:
    """Buckets of several batches, added up."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counters = [c for c in every.columns if c not in (*key, "minute")]
    return every.groupBy(*key, "minute").agg(*(F.sum(c).alias(c) for c in counters))


def trailing(bucketed: DataFrame, key: list[str], cut: int, counters: list[str], windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Per key the sums of each counter over each window, as counter_window.  Keys without any in the longest are left out.

    The filter on the longest window reaches the files; one aggregate serves all windows.
    """
    longest = max(windows.values())
    rows = bucketed.where((F.col("minute") > cut - longest) & (F.col("minute") <= cut))
    sums = [F.sum(F.when(F.col("minute") > cut - length, F.col(c)).otherwise(0)).alias(f"{c}_{name}") for c in counters for name, length in windows.items()]
    return rows.groupBy(*key).agg(*sums)


def next_expiry(bucketed: DataFrame, key: list[str], cut: int, counted: Column, engaged: Column) -> DataFrame:
    """The next minute at which a key's counts change without any event, if there is one.

    A bucket leaves each window that long after its minute.  counted buckets leave all windows,
    those that are only engaged the longest.
    """
    lengths = list(WINDOWS.values())
    leaves = F.array(*(F.when(counted if n < lengths[-1] else counted | engaged, F.col("minute") + n) for n in lengths))
    return bucketed.select(*key, F.explode(leaves).alias("at")).where(F.col("at") > cut).groupBy(*key).agg(F.min("at").alias("next_expiry"))


def recalculated(projection: DataFrame, bucketed: DataFrame, key: list[str], now: int, counters: list[str]) -> DataFrame:
    """Trailing counts at `now` of the keys whose next_expiry has come; jumps over what was missed."""
    due = projection.where(F.col("next_expiry") <= now).select(*key)
    counts = trailing(bucketed.join(due, key, "left_semi"), key, now, counters)
    zero = [c for c in counts.columns if c not in key]
    return due.join(counts, key, "left").fillna(0, zero)


def nested(counts: DataFrame, counters: list[str]) -> Column:
    """Whether shorter windows never count more than longer ones: an invariant of trailing()."""
    names = list(WINDOWS)
    out = F.lit(True)
    for c in counters:
        for a, b in zip(names, names[1:], strict=False):
            out = out & (F.col(f"{c}_{a}") <= F.col(f"{c}_{b}"))
    return out


class Watermarks:
    """Points up to which history may go, by kind; they only advance, and cleanup never passes them.

    With files they are kept there, as numbered versions of which one writer creates each, so that they
    outlive the driver and several drivers agree on them; without, they last as long as this object.
    """

    def __init__(self, files: Files | None = None, **start: int) -> None:
        self._files, self._own = files, dict(start)
        for kind, to in start.items():
            self.advance(kind, to)

    def _current(self) -> tuple[int, dict[str, int]]:
        if self._files is None:
            return 0, self._own
        numbers = [int(n[:-5]) for n in self._files.names("watermarks") if n.endswith(".json")]
        last = max(numbers, default=0)
        return last, self._files.read_json(f"watermarks/{last:012d}.json") if last else {}

    def at(self, kind: str) -> int:
        return self._current()[1].get(kind, -1)

    def advance(self, kind: str, to: int) -> int:
        while True:
            number, now = self._current()
            if self._files is None or now.get(kind, -1) >= to:
                now[kind] = max(now.get(kind, -1), to)
                return now[kind]
            try:
                self._files.create_json(f"watermarks/{number + 1:012d}.json", now | {kind: to})
            except ConcurrentWriteError:
                continue  # another driver was first; its version counts too
            if number > 1:  # the last but one stays for readers that have just seen it
                self._files.remove(f"watermarks/{number - 1:012d}.json")
            return to

    def allow(self, kind: str, upto: int) -> int:
        if upto > self.at(kind):
            raise InvalidArgumentError(f"{kind} may be cleaned up to {self.at(kind)}, not to {upto}")
        return upto


def expired(bucketed: DataFrame, cuts: DataFrame, key: list[str], upto: int) -> DataFrame:
    """Buckets that may be deleted: out of the longest window both at `upto` and at their key's projected cut."""
    longest = max(WINDOWS.values())
    old = bucketed.where(F.col("minute") <= upto - longest)
    return old.join(cuts.select(*key, F.col("cut").alias("__cut")), key).where(F.col("minute") <= F.col("__cut") - longest).drop("__cut")


def retained(bucketed: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return bucketed.join(gone.select(*key, "minute"), [*key, "minute"], "left_anti")
