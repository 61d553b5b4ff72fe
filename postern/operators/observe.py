"""Counters and durations of operations, and row metrics of DataFrames while they run."""

from __future__ import annotations

import contextlib
import time
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Upper ends of the duration histogram, in seconds.
BOUNDS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)


class Metrics:
    """Operations by name and outcome, and a histogram of their durations."""

    def __init__(self) -> None:
        self.operations: Counter[tuple[str, str]] = Counter()
        self.durations: dict[str, list[int]] = defaultdict(lambda: [0] * (len(BOUNDS) + 1))
        self.work: Counter[str] = Counter()

    @contextlib.contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began, outcome = time.monotonic(), "ok"
        try:
            yield
        except Exception as e:
            outcome = type(e).__name__
            raise
        finally:
            took = time.monotonic() - began
            self.operations[name, outcome] += 1
            self.durations[name][sum(took > b for b in BOUNDS)] += 1

    def observed(self, df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        """df counting its rows while an action runs over it; the observation waits for that action."""
        seen = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def record(self, name: str, seen: Observation) -> int:
        rows = seen.get["rows"]
        self.work[name] += rows
        return rows
