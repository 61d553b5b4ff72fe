"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: words of the text (A-Z lower-cased), shingles of `width` words with repeats, each
hashed by XXH64; a bit is set if it is set in over half of the hashes.  Fingerprints link at
`RADIUS` = 3 or fewer differing bits, and components are the classes.

Half of 3 is not whole, so the odd bit is taken up by a wildcard: the 64 bits are cut into three
blocks, and for each block every fingerprint emits, with that block wiped, itself and all its
variants of one flipped bit elsewhere (131 keys in all, where balls of radius 2 would be 2081).
Of two linked fingerprints that do not differ in a single block only, some block holds exactly
one of the differing bits or none, and the at most two bits elsewhere are met half way: one is
flipped by either side.  Within a key,

1. members with the same wiped bits differ in at most two places: all are linked, and a chain
   through them says so;
2. members whose wiped bits differ in one place differ in at most three: all are linked, and one
   edge between the two chains says so, found by looking up the flipped values, never by
   comparing all pairs;
3. members that emitted the key unflipped differ in the wiped block only: values in it that
   differ in up to three places are looked up, or compared in blocks when they are few.

Only distinct fingerprints take part, so copies cost nothing, and a key's distinct wiped values
number at most 2**22 whatever the corpus, which bounds what a task holds.  Every emitted edge is
verified by counting differing bits.  The edges form a forest per task; components are then found
by alternating star contraction over written tables.

near_dedup does the same at a similarity of 0.8, with longer fingerprints and balls around bands of them.

A text without words has fingerprint zero and is linked like any other.  Null ids take part in the
links, and a component without any id gets a null component_id.  Every input row gives one output
row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from postern.llm.common import remove, written, written_at

RADIUS = 3
SEED = 42
BLOCKS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits); together all 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(raw: bytes, width: int) -> int:
    """SimHash of a text in UTF-8, unsigned."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= width:
        return xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64, n - width + 1)
    # How often each byte value stands at each byte place gives the count of every bit.
    places = hashes.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = 2 * counts.ravel() > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = (fingerprint(x.as_py() or b"", width) for x in batch.column(1).cast(pa.binary()))
            fps = np.fromiter(prints, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _masks() -> list[tuple[int, int, int]]:
    """(block, mask that wipes the block, bit to flip or 0) of all keys of a fingerprint, signed."""
    out = []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for b, (first, bits) in enumerate(BLOCKS):
        block = ((1 << bits) - 1) << first
        keep = signed(~block & ((1 << 64) - 1))
        out.append((b, keep, 0))
        out += [(b, keep, signed(1 << i)) for i in range(64) if not block >> i & 1]
    return out


def spread(rows: DataFrame, bytes_each: int) -> DataFrame:
    """rows dealt over so many tasks that what each row becomes, bytes_each, stays near 64 MB a task."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * bytes_each // (64 << 20)))
    return rows.repartition(tasks)


def ball_keys(distinct: DataFrame) -> DataFrame:
    """block, key and fp: every variant of every fingerprint; built-in expressions only."""
    masks = F.array(*(F.struct(F.lit(b).cast("byte").alias("block"), F.lit(k).cast("long").alias("keep"), F.lit(f).cast("long").alias("flip")) for b, k, f in _masks()))
    emitted = spread(distinct, 24 * len(_masks())).select("fp", F.explode(masks).alias("m"))
    return emitted.select(F.col("m.block").alias("block"), F.col("fp").bitwiseXOR(F.col("m.flip")).bitwiseAND(F.col("m.keep")).alias("key"), "fp")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def bucket_edges(fps: np.ndarray, key: int, block: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect all linked members of one key, given its distinct fingerprints."""
    first, bits = BLOCKS[block]
    low = np.uint64(first)
    inside = (fps >> low) & np.uint64((1 << bits) - 1)
    order = np.argsort(inside, kind="stable")
    fps, inside = fps[order], inside[order]
    same = inside[1:] == inside[:-1]
    out = [(fps[:-1][same], fps[1:][same])]
    heads = np.flatnonzero(np.r_[True, ~same])
    values, reps = inside[heads], fps[heads]

    def looked_up(values: np.ndarray, reps: np.ndarray, flips: np.uint64) -> None:
        wanted = values ^ flips
        at = np.searchsorted(values, wanted)
        at[at == len(values)] = 0
        hit = (values[at] == wanted) & (values < wanted)
        if hit.any():
            out.append((reps[hit], reps[at[hit]]))

    if len(values) > 1:
        for i in range(bits):
            looked_up(values, reps, np.uint64(1 << i))
    block_mask = np.uint64(((1 << bits) - 1) << first)
    centre = (fps & ~block_mask) == np.uint64(key)
    values, reps = inside[centre], fps[centre]
    if len(values) > 1:
        if len(values) <= 2048:  # fewer comparisons than lookups
            for i in range(len(values) - 1):
                near = differing(values[i + 1 :], values[i]) <= RADIUS
                if near.any():
                    others = reps[i + 1 :][near]
                    out.append((np.full(len(others), reps[i]), others))
        else:
            for k in (2, 3):
                for places in combinations(range(bits), k):
                    looked_up(values, reps, np.uint64(sum(1 << p for p in places)))
    return out


#: Keys of at most so many members are compared within themselves, all keys of a batch at once.
SMALL = 12


def _small_edges(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = ends - starts
    for lag in range(1, SMALL):
        some = (sizes > lag) & (sizes <= SMALL)
        if not some.any():
            return
        left = np.concatenate([starts[some] + k for k in range(SMALL - lag)])
        left = left[left + lag < np.tile(ends[some], SMALL - lag)]
        near = differing(fps[left], fps[left + lag]) <= RADIUS
        yield fps[left[near]], fps[left[near] + lag]


class Forest:
    """Union-find over fingerprints; keeps the edges that join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        self.parent[max(a, b)] = min(a, b)
        return True


#: A task's forest is handed on and begun anew after so many edges, which bounds its memory.
FOREST_EDGES = 1_000_000


def links(keys: DataFrame) -> DataFrame:
    """Verified edges a, b between fingerprints, a spanning forest of each task's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, found = Forest(), []
        held: list[tuple[np.ndarray, ...]] = []  # batches of one key that may go on, but for the newest

        def settle(blocks: np.ndarray, names: np.ndarray, fps: np.ndarray) -> None:
            new = np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(names)]
            pairs = list(_small_edges(fps, starts, ends))
            for s, e in zip(*(x[ends - starts > SMALL].tolist() for x in (starts, ends)), strict=True):
                pairs += bucket_edges(fps[s:e], int(names[s]) & (1 << 64) - 1, int(blocks[s]))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                right = differing(a, b) <= RADIUS
                edges = np.unique(np.stack([np.minimum(a, b)[right], np.maximum(a, b)[right]]), axis=1)
                found.extend((x, y) for x, y in zip(*edges.tolist(), strict=True) if forest.join(x, y))

        def handed() -> pa.RecordBatch:
            nonlocal forest, found
            a = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            forest, found = Forest(), []
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held.append((blocks, names, batch.column(2).to_numpy().view(np.uint64)))
            if (blocks[-1], names[-1]) == (held[0][0][0], held[0][1][0]):  # one key so far
                continue
            blocks, names, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            rest = np.flatnonzero((names != names[-1]) | (blocks != blocks[-1]))[-1] + 1
            settle(blocks[:rest], names[:rest], fps[:rest])
            held = [(blocks[rest:], names[rest:], fps[rest:])]
            if len(found) >= FOREST_EDGES:
                yield handed()
        if held:
            settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield handed()

    dealt = keys.repartition("block", "key").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of edges a, b."""
    return components_at(edges)[0]


def components_at(edges: DataFrame) -> tuple[DataFrame, str]:
    """As components(), with the folder of the table that it reads.

    Alternating stars: each round points the greater neighbours of a node to its least one, then
    all lesser neighbours to the least.  Logarithmic in the longest path; each round reads and
    writes a table in the shared folder.  Nodes with many neighbours are met by aggregates and
    joins that combine before they shuffle, never by collecting the neighbours.
    """
    spark = edges.sparkSession
    now, path = written_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    settled = False
    while not settled:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = now.select(F.col("v").alias("at"), F.col("u").alias("far"))  # far is a greater neighbour of at
        large = large.join(least, large["at"] == least["u"]).select(F.col("far").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after, next_path = written_at(turned.select("e.u", "e.v").where("u != v").distinct(), "edges")
        settled = _signature(after) == _signature(now)
        remove(spark, path)  # nothing reads an earlier round any more
        now, path = after, next_path
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), path


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def classes(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (the least id in the component) of every row."""
    prints = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    found, path = written_at(links(ball_keys(prints.select("fp").distinct())), "links")
    roots = components(found)
    remove(docs.sparkSession, path)
    firsts = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    placed = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
