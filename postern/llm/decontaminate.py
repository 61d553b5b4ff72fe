"""Benchmark decontamination: a prefix-filtered join, verified exactly over item-sized windows.

A benchmark item becomes windows of `size` consecutive words (a shorter item is one window).  A
document is hit wherever one of these windows occurs in it, word for word.  The join:

* shingles of three words are ordered by rarity, counted over all documents;
* a document that holds a window holds every shingle of it, so one necessary prefix token is
  enough: the window's rarest shingle.  Documents are joined on those alone;
* positional and length bounds: where the shingle lies in the window says where the window would
  start, and it must lie within the document;
* what is left is compared word by word, so hash collisions cost time but are never reported.

The index of a benchmark is broadcast, so its size is checked: a benchmark larger than `block_bytes` of text is cut
into blocks of about that size, and a block whose built index is larger than `BUILT_BYTES` is halved again (a long item
between its windows).  Each block is joined with all documents in a job of its own, so that a task has one index at a
time, and its broadcast is released.  Documents are never shuffled; with several blocks only the hit places of each are,
and the stage that filters reads documents once more against the hashes of the texts that were hit.

Null texts have no words.  An item without words is ignored; items that repeat an id count once,
and a null item_id counts as the empty string.  Without documents the result is empty, without
benchmark no document is hit.  Every document row gives one output row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.llm.common import written

BLOCK_BYTES = 4_000_000
BUILT_BYTES = 128_000_000
#: Words of an item that are indexed together.
PIECE = 100_000
SHINGLE = 3
#: Words of documents that are looked at together.
BATCH_WORDS = 1_000_000
#: Candidate places that are compared together.
BATCH_PLACES = 200_000

#: ASCII letters in lower case and digits stay, other ASCII becomes a blank, all else is part of words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def words_of(raw: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased, of a text in UTF-8."""
    return raw.translate(_TABLE).split()


@dataclass
class Index:
    """A block of the benchmark: numbered words, windows as rows of numbers, and their shingles."""

    numbers: dict[bytes, int]
    windows: np.ndarray  # padded with 0
    lengths: np.ndarray
    items: list[str]  # sorted
    owned: np.ndarray  # places in items, window by window
    starts: np.ndarray  # where each window's begin, and the end
    shingles: dict[int, np.ndarray]  # length of shingle -> its sorted hashes
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None  # hashes, first entry of each, windows, offsets

    def owners(self, window: int) -> list[str]:
        return [self.items[k] for k in self.owned[self.starts[window] : self.starts[window + 1]].tolist()]

    def nbytes(self) -> int:
        """What the index takes in memory, about; a word of the dictionary is counted as 150 bytes."""
        arrays = [self.windows, self.lengths, self.owned, self.starts, *self.shingles.values()]
        return sum(a.nbytes for a in arrays) + 150 * len(self.numbers) + 24 * len(self.windows) + sum(map(len, self.items))


def mixed(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` numbers; 0 stands for runs that hold a foreign word."""
    n = max(0, len(ids) - length + 1)
    out = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for k in range(length):
        part = ids[k : k + n]
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        known &= part > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def build(items: list[tuple[object, bytes]], size: int) -> Index:
    numbers: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, raw in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(raw)]
        name = "" if item is None else str(item)
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            owners[tuple(ids[i : i + size])].add(name)
    lengths = np.array([len(w) for w in owners], np.int64)
    windows = np.zeros((len(owners), size), np.uint32)
    for row, w in zip(windows, owners, strict=True):
        row[: len(w)] = w
    names = sorted({x for own in owners.values() for x in own})
    place = {x: k for k, x in enumerate(names)}
    owned = np.array([place[x] for own in owners.values() for x in sorted(own)], np.int32)
    starts = np.cumsum([0, *(len(own) for own in owners.values())])
    shingles = {}
    for length in range(1, SHINGLE + 1):
        mine = windows[np.minimum(lengths, SHINGLE) == length]
        if len(mine):
            found = np.unique(np.concatenate([mixed(row.astype(np.uint64), length) for row in mine]))
            shingles[length] = found[found > 0]
    return Index(numbers, windows, lengths, names, owned, starts, shingles)


def pick_rarest(index: Index, counts: dict[int, np.ndarray]) -> None:
    """Sets the index's prefix: each window under its shingle with the fewest places in the documents."""
    index.prefix = {}
    for length, hashes in index.shingles.items():
        rows = np.flatnonzero(np.minimum(index.lengths, SHINGLE) == length)
        chosen, offsets = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for k, r in enumerate(rows):
            at = np.searchsorted(hashes, mixed(index.windows[r, : index.lengths[r]].astype(np.uint64), length))
            offsets[k] = best = int(np.argmin(counts[length][at]))
            chosen[k] = at[best]
        order = np.argsort(chosen, kind="stable")
        used, firsts = np.unique(chosen[order], return_index=True)
        index.prefix[length] = (hashes[used], np.r_[firsts, len(rows)], rows[order], offsets[order])


def _numbered(batch: pa.RecordBatch, column: int, numbers: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words of each row, all rows' numbers), some rows at a time.

    Rows are set apart by foreign words (0), so that no shingle or window spans two of them.
    """
    get, first, sizes, parts, total = numbers.get, 0, [], [], 0
    for i, raw in enumerate(batch.column(column).cast(pa.binary())):
        words = words_of(raw.as_py() or b"")
        sizes.append(len(words))
        parts.append(np.array([get(w, 0) for w in words] + [0], np.uint64))
        total += len(words) + 1
        if total >= BATCH_WORDS or i == batch.num_rows - 1:
            yield first, np.array(sizes, np.int64), np.concatenate(parts)
            first, sizes, parts, total = i + 1, [], [], 0


def _found(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that are among the sorted hashes, and which they are."""
    places = np.flatnonzero(keys)
    at = np.searchsorted(hashes, keys[places])
    at[at == len(hashes)] = 0
    right = hashes[at] == keys[places] if len(hashes) else np.zeros(len(places), bool)
    return places[right], at[right]


def shingle_counts(docs: DataFrame, index: Broadcast) -> dict[int, np.ndarray]:
    """Places of every shingle of the index over all documents; the result is as large as the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        counts = {length: np.zeros(len(h), np.int64) for length, h in own.shingles.items()}
        for batch in batches:
            for _, _, ids in _numbered(batch, 0, own.numbers):
                for length, hashes in own.shingles.items():
                    counts[length] += np.bincount(_found(hashes, mixed(ids, length))[1], minlength=len(hashes))
        for length, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), length, np.int32)), pa.array(some), pa.array(c[some])], ["length", "at", "n"])

    summed = docs.select(F.col("text").cast("string")).mapInArrow(run, "length int, at long, n long").groupBy("length", "at").agg(F.sum("n").alias("n"))
    out = {length: np.zeros(len(h), np.int64) for length, h in index.value.shingles.items()}
    for r in summed.toLocalIterator():
        out[r["length"]][r["at"]] = r["n"]
    return out


def matches(index: Index, sizes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start within ids, window) of every occurrence of a window."""
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = index.windows.shape[1]
    for length, (hashes, firsts, windows, offsets) in index.prefix.items():
        places, at = _found(hashes, mixed(ids, length))
        many = firsts[at + 1] - firsts[at]
        upto = np.cumsum(many)
        for a in range(0, int(upto[-1]) if len(upto) else 0, BATCH_PLACES):
            k = np.arange(a, min(a + BATCH_PLACES, int(upto[-1])))
            which = np.searchsorted(upto, k, side="right")
            entry = firsts[at[which]] + k - (upto[which] - many[which])
            window, begin = windows[entry], places[which] - offsets[entry]
            row = np.searchsorted(ends, places[which])
            fits = (begin >= starts[row]) & (begin + index.lengths[window] <= ends[row])
            row, begin, window = row[fits], begin[fits], window[fits]
            for j in range(width):
                same = (j >= index.lengths[window]) | (ids[np.minimum(begin + j, len(ids) - 1)] == index.windows[window, j])
                row, begin, window = row[same], begin[same], window[same]
            yield row, begin - starts[row], window


def hits(docs: DataFrame, index: Broadcast, id_col: str) -> DataFrame:
    """Per document row: id, text_hash, n_words, spans (start, end, start, ... of hit words), items."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            for first, sizes, ids in _numbered(batch, 2, own.numbers):
                spans: list[list[int]] = [[] for _ in sizes]
                items: list[set[str]] = [set() for _ in sizes]
                for row, begin, window in matches(own, sizes, ids):
                    for r, b, w in zip(row.tolist(), begin.tolist(), window.tolist(), strict=True):
                        spans[r].append((b, b + int(own.lengths[w])))
                        items[r].update(own.owners(w))
                part = batch.slice(first, len(sizes))
                flat = [[x for span in merged(s) for x in span] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    [id_col, "text_hash", "n_words", "spans", "items"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, f"`{id_col}` {kind}, text_hash long, n_words long, spans array<long>, items array<string>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(item: object, raw: bytes, size: int, most: int) -> Iterator[tuple[object, bytes]]:
    """An item in parts of at most about `most` words that have all its windows between them."""
    words = words_of(raw)
    if len(words) <= most + size:
        yield item, raw
        return
    for a in range(0, len(words) - size + 1, most):
        yield item, b" ".join(words[a : a + most + size - 1])


def built(items: list[tuple[object, bytes]], size: int, most_bytes: int) -> Iterator[Index]:
    """The items' index, in halves of halves where it is too large."""
    index = build(items, size)
    if index.nbytes() <= most_bytes or len(items) < 2:
        yield index
    else:
        del index
        for half in (items[: len(items) // 2], items[len(items) // 2 :]):
            yield from built(half, size, most_bytes)


def blocks(benchmark: DataFrame, size: int, block_bytes: int, built_bytes: int = BUILT_BYTES, piece: int = PIECE) -> Iterator[Index]:
    """The benchmark's index, in blocks of about block_bytes of text."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator()
        yield from built([p for r in mine for p in pieces(r["item_id"], r["text"].encode(), size, piece)], size, built_bytes)


def prepared(docs: DataFrame, index: Index) -> Broadcast:
    """The index with its prefixes chosen, broadcast."""
    context = docs.sparkSession.sparkContext
    if len(index.lengths):
        plain = context.broadcast(index)
        counts = shingle_counts(docs, plain)
        plain.destroy()
    else:
        counts = {}
    pick_rarest(index, counts)
    return context.broadcast(index)


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of every document row."""
    # An index is let go before the next one is built.
    found = [hits(docs, prepared(docs, index), id_col) for index in blocks(benchmark, size, block_bytes)]
    if len(found) == 1:
        rows = found[0].withColumn("copies", F.lit(1).cast("long"))
    else:
        every = found[0].withColumn("copies", F.lit(1).cast("long"))
        for other in found[1:]:
            every = every.unionByName(other.withColumn("copies", F.lit(0).cast("long")))
        rows = every.groupBy(id_col, "text_hash").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_set("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
            F.sum("copies").alias("copies"),
        )
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digests = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n_hit.append(sum(b - a for a, b in merged(list(zip(spans[::2], spans[1::2], strict=True)))))
                n_items.append(len(items))
                digests.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), batch.column(4)], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "copies"])

    out = rows.select(id_col, "n_words", "spans", "items", "copies").mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, copies long")
    if len(found) > 1:
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(id_col, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def filter_stage(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES, built_bytes: int = BUILT_BYTES) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    waiting, hit = None, []
    for index in blocks(benchmark, size, block_bytes, built_bytes):
        if waiting is not None:
            hit.append(_hit_texts(docs, waiting))
        waiting = prepared(docs, index) if len(index.lengths) else None
    if waiting is None and not hit:
        return docs
    if not hit:  # one block: the rows themselves go through its map
        return docs.mapInArrow(_cleaner(waiting), docs.schema)
    if waiting is not None:
        hit.append(_hit_texts(docs, waiting))
    texts = hit[0]
    for other in hit[1:]:
        texts = texts.unionByName(other)
    # The row travels as one value, so its columns can have any names.
    rows = docs.select(F.struct("*").alias("row"), *_text_key(F.col("text").cast("string")))
    return rows.join(texts.distinct(), ["h1", "h2"], "left_anti").select("row.*")


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; null and all texts that are no hit never meet one."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def _hit_texts(docs: DataFrame, index: Broadcast) -> DataFrame:
    """h1, h2 of the texts that one block hits, as a table; the block's broadcast is released."""
    text = F.col("text").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cleaner(index, True)(batches):
            yield part.select(["h1", "h2"])

    out = written(docs.select(text.alias("text"), *_text_key(text)).mapInArrow(run, "h1 long, h2 long").distinct(), "hit-texts")
    index.destroy()
    return out


def _cleaner(index: Broadcast, hit: bool = False):
    """Of batches with a column text, the rows without a hit, or those with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, sizes, ids in _numbered(batch, batch.schema.get_field_index("text"), index.value.numbers):
                for row, _, _ in matches(index.value, sizes, ids):
                    keep[first + row] = False
            yield batch.filter(pa.array(keep != hit))

    return run


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT size FROM bw
), dw AS (
    SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), m AS (
    SELECT r, i, dw.size, item_id FROM dw JOIN bw USING (win)
), h AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r
), it AS (
    SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
