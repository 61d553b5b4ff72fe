"""Limits of queries, records and tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from postern.errors import ArgumentRangeError

# Limits of the query contract.
PLAN_DEPTH = 64
PLAN_NODES = 256
WHERE_IN_VALUES = 64
FACET_TEXT_BYTES = 16_384

# Capacity of a record.
ENTRIES_PER_RECORD = 256
ENTRIES_PER_INDEX = 64
ENTRY_BYTES = 64 * 1024
ENTRIES_BYTES = 512 * 1024
PAYLOAD_BYTES = 4 * 1024 * 1024
TYPE_BYTES = 1024
KEY_BYTES = 4096

# Deltas between compactions, and the most that a reader replays.
COMPACT_AFTER = 1024
REPLAY_LIMIT = 4096


@dataclass(frozen=True)
class QueryOptions:
    """Ceilings of object terminals; DataFrame terminals are lazy and have none.

    rounds are the pages of one walk, facet_items the different values that a facet may count.
    """

    page_size: int = 128
    page_bytes: int = 1024 * 1024
    token_bytes: int = 2048
    result_items: int = 8192
    result_bytes: int = 8 * 1024 * 1024
    rounds: int = 64
    facet_top_n: int = 128
    facet_items: int = 8192
    facet_bytes: int = 8 * 1024 * 1024

    def __post_init__(self) -> None:
        for f in fields(self):
            value, most = getattr(self, f.name), MAXIMA[f.name]
            if not 1 <= value <= most:
                raise ArgumentRangeError(f"{f.name} must be from 1 to {most}, not {value}")


# What options can be raised to.
MAXIMA = {
    "page_size": 1024,
    "page_bytes": 4 * 1024 * 1024,
    "token_bytes": 32 * 1024,
    "result_items": 100_000,
    "result_bytes": 64 * 1024 * 1024,
    "rounds": 1024,
    "facet_top_n": 1024,
    "facet_items": 65_536,
    "facet_bytes": 64 * 1024 * 1024,
}
