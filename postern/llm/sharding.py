"""Sharding by a minimax contiguous partition, in DataFrame functions only.

Equal texts form a group and stay together.  The groups are put in the order of a hash of their text (63 bits; texts of
equal hash count as one group), which mixes sources and lengths, and are cut into contiguous shards of the smallest
feasible capacity: a binary search over capacities, each checked greedily.

The driver does not need every group's size for that.  It holds the sizes of cells, ranges of the hash: first `n_cells`
equal ones, counted in one aggregate, and of each whether it is a single group.  A check that may cut cells of several
groups anywhere gives a lower bound of the capacity, one that takes all cells whole gives an upper bound.  While they
differ, the cells that cuts of the lower to the upper bound fall into are counted anew in finer cells.  When they
agree, the capacity is exactly that of the groups, whatever their number, and cells that no cut falls into were never
looked into.  The cuts are then made between cells within that capacity, as evenly as it allows, so that one huge
group of copies does not leave the shards behind it empty.

The law that holds is `bytes`: sizes are near equal.  No partition of the groups in this order has a smaller largest
shard.

Null texts count as empty ones.  Null and repeated doc_ids are rows like others.  Shards stay empty only if there are
fewer groups than shards; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postern.llm.common import written

OVERHEAD = 16
GROUP_BITS = 63


def shards_needed(prefix: list[int], capacity: int, most: int) -> int:
    """Shards that the greedy rule fills in order; most + 1 stands for any larger number."""
    at, used, last = 0, 0, len(prefix) - 1
    while at < last and used <= most:
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        used += 1
    return used


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which the sizes, in order, fit into the shards."""
    prefix = [0, *accumulate(sizes)]
    low = max(max(sizes), -(-prefix[-1] // shards))
    high = low + max(sizes)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(prefix, middle, shards) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """First place of each shard after the first; the largest shard has the smallest capacity."""
    n = len(sizes)
    if n <= shards:
        return list(range(1, n))
    prefix = [0, *accumulate(sizes)]
    capacity = smallest_capacity(sizes, shards)
    rest = [0] * (n + 1)  # shards needed from a place on
    for i in range(n - 1, -1, -1):
        rest[i] = 1 + rest[bisect_right(prefix, prefix[i] + capacity) - 1]
    descending = [-x for x in rest]
    # Sizes above the mean of the others have a shard of their own, and no say in the mean.
    heavy: set[int] = set()
    rest_size = prefix[-1]
    while more := {i for i in range(n) if i not in heavy and sizes[i] * (shards - len(heavy)) > rest_size}:
        heavy |= more
        rest_size -= sum(sizes[i] for i in more)
    light = [0, *accumulate(0 if i in heavy else s for i, s in enumerate(sizes))]
    ahead = [0, *accumulate(i in heavy for i in range(n))]
    out, at = [], 0
    for left in range(shards, 1, -1):
        goal = (light[n] - light[at]) / max(1, left - (ahead[n] - ahead[at]))
        stop = bisect_left(ahead, ahead[at] + 1) - 1 if ahead[n] > ahead[at] else n
        if stop > at:  # whole shards up to the next heavy one
            goal = (light[stop] - light[at]) / max(1, round((light[stop] - light[at]) / goal))
        first = max(at + 1, bisect_left(descending, -(left - 1)))
        last = max(first, min(bisect_right(prefix, prefix[at] + capacity) - 1, n - left + 1))
        near = bisect_left(prefix, prefix[at] + goal)
        if near - 1 > at and prefix[at] + goal - prefix[near - 1] < prefix[min(near, n)] - prefix[at] - goal:
            near -= 1
        at = min(max(near, first), last)
        out.append(at)
    return out


@dataclass(frozen=True, order=True)
class Cell:
    """The hashes from first up to first + 2**bits, which hold some rows: their size, and whether they are one group."""

    first: int
    bits: int
    size: int
    single: bool


def loose_cuts(cells: list[Cell], prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts in sizes before them, if cells of several groups can be cut anywhere; None if shards do not suffice."""
    at, out = 0, []
    while at + capacity < prefix[-1]:
        i = bisect_right(prefix, at + capacity) - 1
        to = prefix[i] if cells[i].single else at + capacity
        if to <= at or len(out) == shards - 1:
            return None
        out.append(to)
        at = to
    return out


def to_refine(cells: list[Cell], shards: int) -> list[Cell]:
    """Cells that have to be known more finely before the smallest capacity is known; none if it is."""
    if len(cells) < shards:
        return [c for c in cells if not c.single]
    prefix = [0, *accumulate(c.size for c in cells)]
    low, high = max(1, -(-prefix[-1] // shards)), smallest_capacity([c.size for c in cells], shards)
    most = high
    while low < high:
        middle = (low + high) // 2
        if loose_cuts(cells, prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    if low == most:
        return []
    out = set()
    for a, b in zip(loose_cuts(cells, prefix, low, shards), [*(loose_cuts(cells, prefix, most, shards) or []), *[0] * shards], strict=False):
        out.update(range(bisect_right(prefix, a) - 1, min(bisect_right(prefix, max(a, b)), len(cells))))
    return [cells[i] for i in sorted(out) if not cells[i].single]


def counted(narrow: DataFrame, cells: list[Cell], parts_bits: int) -> list[Cell]:
    """Each of the cells in 2**parts_bits finer ones; those without rows are left out."""
    spark, found = narrow.sparkSession, []
    for bits in {c.bits for c in cells}:
        finer = max(0, bits - parts_bits)
        mine = F.from_json(F.lit(json.dumps([c.first >> bits for c in cells if c.bits == bits])), "array<bigint>")
        asked = spark.range(1).select(F.explode(mine).alias("cell"))  # at most n_cells, and what is counted once more is at most that many again
        inside = narrow.join(F.broadcast(asked), F.shiftright("group", bits) == F.col("cell"), "left_semi")
        sums = inside.groupBy(F.shiftright("group", finer).alias("part")).agg(F.sum("size").alias("size"), (F.min("group") == F.max("group")).alias("single"))
        found += [Cell(r["part"] << finer, finer, r["size"], r["single"]) for r in sums.collect()]
    return found


def partition(narrow: DataFrame, shards: int, n_cells: int) -> list[int]:
    """First group of each shard after the first, for rows of group and size."""
    cells = sorted(counted(narrow, [Cell(0, GROUP_BITS, 0, False)], max(1, (n_cells - 1).bit_length())))
    while rough := to_refine(cells, shards):
        fine = counted(narrow, rough, max(1, (n_cells // len(rough)).bit_length() - 1))
        cells = sorted({*cells} - {*rough} | {*fine})
    return [cells[i].first for i in cuts([c.size for c in cells], shards)] if cells else []


def assign(docs: DataFrame, shards: int = 40, n_cells: int = 65536, strands: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The texts are read once, into a narrow table that later steps read.  Slots number the rows of
    a shard without gaps: rows are dealt by hash over strands, strands get their offsets from
    counts (shards x strands rows, a bound on what is broadcast), and rows are numbered within
    a strand, so no task sees a whole shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).alias("group"),
        ),
        "shard-sizes",
    )
    firsts = partition(narrow.select("group", "size"), shards, n_cells)
    shard = sum(((F.col("group") >= F.lit(a)).cast("int") for a in firsts), F.lit(0))
    dealt = narrow.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(strands)).cast("int").alias("strand"))
    counts = dealt.groupBy("shard", "strand").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "strand", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "strand").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        dealt.withColumn("within", within)
        .join(F.broadcast(offsets), ["shard", "strand"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
