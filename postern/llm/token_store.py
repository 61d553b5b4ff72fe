"""Token ids in files: canonical length-limited Huffman codes, decoded by table in independent blocks.

Writing takes three steps, each a table in the shared folder, so a lost executor costs its tasks:

1. documents are put in ascending order of doc_id (null first, then by a hash of the text) by a
   range exchange that can also part equal rows, encoded, and written as segments of about `SEGMENT` ids, which know how many
   ids of their partition come before them;
2. ids are counted over all segments, and the counts (no more than the vocabulary) give each id a
   code length of at most `LIMIT` bits by package-merge, and thereby its canonical code;
3. every segment is written in its final form.

File format.  A folder holds `code` (id, length of every id that occurs) and `segments`, with one
folder per range of doc_ids in ascending order.  A segment is a row (seq, blob), and blob is, in
little-endian order: magic "PTK1", documents u32, ids u64, ids of all documents before u64, block
u32, crc32 of the code u32, crc32 of the rest u32; then per document a byte that is 1 if its id is
null, its id i64 and its number of ids u32; then per block of `BLOCK` ids the bit at which it
starts (u64); then the codes, most significant bit first, in big-endian words of 32 bits.

Reading decodes the blocks of a segment side by side: one table look-up of as many bits as the longest code has gives each
block its next id and the bits to go on by.

An id is a long, or null; an id column of another type is cast, and a text that is no number stops the write.
Null and empty texts have the end id only.  Repeated rows are documents like others.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.llm.common import remove, scratch, written_at

END_ID = 2
LIMIT = 16
BLOCK = 256
SEGMENT = 1 << 18
#: Characters of text that are cut into pieces together.
CHUNK = 1 << 20

HEAD = struct.Struct("<4sIQQIII")

# --- encoding ----------------------------------------------------------------------------------

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts a text where the byte-level tokenizer's own pattern always cuts it, so pieces can be encoded alone.
_PIECES = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


#: What texts of words with single blanks and line feeds between them do not hold; they are cut without the pattern.
_UNUSUAL = ("  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))

#: What is neither white space nor a letter or digit to the pattern.
_MARKS = punctuation


class Encoder:
    """Encodes texts by the tokenizers library, each distinct piece once while it is remembered.

    A piece is a word, with or without the blank before it, or a run of white space; keys tell them
    apart.  Pieces are
    encoded many at a time, joined by line feeds, which the tokenizer keeps apart; the numbers of
    bytes that the tokens stand for tell where each piece ends.  Marks that end a word behind a letter
    or digit are a piece of their own to the tokenizer, so words are learned without them.  Texts that hold an
    added token's string, and vocabularies that are not byte-level BPE, are encoded as a whole.
    """

    REMEMBERED = 800_000
    LONGEST = 200

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bare = Tokenizer(self.tokenizer.model)
        pre = self.tokenizer.pre_tokenizer
        self.bytewise = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        if self.bytewise:
            self.spans = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
            self.feed = self._alone("\n")
            self.bytewise = len(self.feed) == self.kind.itemsize
            # The vocabulary writes bytes as characters.  One that no longer token holds sets words apart
            # within the model; of those, a byte that UTF-8 never has.
            printed = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
            rest = iter(range(256, 512))
            letters = {c: chr(c) if c in printed else chr(next(rest)) for c in range(256)}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            apart = next((c for c in (0xC0, 0xC1, *range(0xF5, 0x100)) if not any(letters[c] in t for t in vocabulary if len(t) > 1)), None)
            self.apart = None if apart is None else vocabulary.get(letters[apart])
            self.blank, self.mark = letters[32], "" if apart is None else letters[apart]
            self.as_letters = str.maketrans({chr(c): x for c, x in letters.items()} | ({} if self.apart is None else {"\0": letters[apart]}))
        #: Ids of a blank and a word, by the word; of other pieces, by a line feed and the piece, without the line feed's.
        self.known: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[str]) -> None:
        known, longest = self.known, self.LONGEST
        words, ended = [], []
        for p in new:
            if p[-1] in _MARKS and (b := p.rstrip(_MARKS)) and b[-1] < "\u0250" and b[-1].isalnum():
                ended.append((p, b, "\n" + p[len(b) :]))
            else:
                words.append(p)
        parts = set().union([b for _, b, _ in ended], [m for _, _, m in ended])
        words = list(dict.fromkeys(chain(words, parts.difference(known))))
        # Keys of letters only, as far as the vocabulary's own letters go.
        ascii_only, plain, joined = [], [], []
        for p in words:
            if len(p) > longest or p.isspace():
                known[p] = self._alone(p[1:] if p[0] == "\n" else " " + p)
            elif self.apart is None or not (p.isalpha() or (p[0] == "\n" and p[1:].isalpha())):
                joined.append(p)
            elif p.isascii():
                ascii_only.append(p)
            elif max(p) < "\u0250":
                plain.append(p)
            else:
                joined.append(p)
        plain = ascii_only + plain
        w = self.kind.itemsize
        # Letters, with or without a blank before them, are one piece to the pattern, so they can go to the model as they are.
        # The model takes many short runs of words faster than a long one.
        for i in range(0, len(plain), 10_000):
            group = plain[i : i + 10_000]
            runs = ["".join([p[1:] + "\0" if p[0] == "\n" else f" {p}\0" for p in group[k : k + 50]]) for k in range(0, len(group), 50)]
            runs = [r.replace(" ", self.blank).replace("\0", self.mark) if r.isascii() else r.encode().decode("latin-1").translate(self.as_letters) for r in runs]
            ids = np.array([x for e in self.bare.encode_batch_fast(runs, add_special_tokens=False) for x in e.ids], self.kind)
            stops = (np.flatnonzero(ids == self.apart) * w).tolist()
            coded = ids.tobytes()
            known.update(zip(group, [coded[a:b] for a, b in zip([0, *(x + w for x in stops[:-1])], stops, strict=True)], strict=True))
        for i in range(0, len(joined), 2000):
            group = joined[i : i + 2000]
            # Line feeds set pieces apart: after one that the key has, or before a word's blank.
            text = "".join([p if p[0] == "\n" else "\n " + p for p in group])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum(self.spans[ids])
            raw = np.frombuffer(text.encode(), np.uint8)
            feeds = np.flatnonzero(raw == 10)
            starts = np.searchsorted(ends, feeds + 1)
            if len(feeds) != len(group) or not np.array_equal(ends[starts], feeds + 1):
                known.update((p, self._alone(p[1:] if p[0] == "\n" else " " + p)) for p in group)
                continue
            coded, begin = ids.tobytes(), ((starts + 1) * w).tolist()
            known.update(zip(group, [coded[i:j] for i, j in zip(begin, [*(starts[1:] * w).tolist(), len(coded)], strict=True)], strict=True))
        known.update([(p, known[b] + known[m]) for p, b, m in ended])

    def _pieces(self, text: str) -> list[str]:
        """Keys of the text's pieces."""
        return [p[1:] if len(p) > 1 and p[0] == " " and not p[1].isspace() else "\n" + p for p in _PIECES.findall(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian numbers of self.kind."""
        # Millions of strings and no cycles: the collector would only look at them again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        usual, lines, unusual, cut = [], [], [], []
        for i, t in enumerate(texts):
            if not self.bytewise or any(map(t.__contains__, self.added)):
                out[i] = self._alone(t)
            elif t and not any(map(t.__contains__, _UNUSUAL)) and t[0] not in " \n" and t[-1] not in " \n":
                usual.append(i)
                lines.append("\n" + t.replace("\n", " \n\n \n"))
            elif t:
                unusual.append(i)
                cut.append(self._pieces(t))
        if not usual and not unusual:
            return out
        # Each distinct piece of all texts is looked up once; arrow puts the ids of all pieces together.
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        pieces = pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(cut)), pa.large_string())]).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        gaps = [k for k, b in enumerate(found) if b is None]
        if gaps:
            new, known = [words[k] for k in gaps], self.known
            self._learn(new)
            for k, p in zip(gaps, new, strict=True):
                found[k] = known[p]
            for p in new:
                if len(p) > self.LONGEST:
                    b = p.rstrip(_MARKS)
                    for x in (p, b, "\n" + p[len(b) :]):
                        known.pop(x, None)
            if len(known) > self.REMEMBERED:
                # Pieces learned lately go; the first to come, mostly the frequent ones, stay.
                for p in list(known)[self.REMEMBERED // 2 :]:
                    del known[p]
        coded = pa.array(found, pa.large_binary()).take(pieces.indices)
        counts = [0, *pc.list_value_length(split).to_pylist(), *map(len, cut)]
        ends = np.frombuffer(coded.buffers()[1], np.int64)[np.cumsum(counts)].tolist()
        ids = memoryview(coded.buffers()[2])
        for i, a, b in zip([*usual, *unusual], ends, ends[1:], strict=False):
            out[i] = bytes(ids[a:b])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(path)


def segments(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Rows part, seq, before (ids of the part before them), n_tokens, nulls, doc_ids, counts, ids, used and
    times (the distinct ids and how often each occurs); all but the first four are binary."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("p"))
    # Equal rows can stand in any order, so many of them are dealt over several ranges by where they come from.
    ordered = rows.repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], own.kind).tobytes()
        seq = before = held = 0
        names: list[int | None] = []
        coded: list[bytes] = []

        def segment() -> pa.RecordBatch:
            nonlocal seq, before, held, names, coded
            counts = np.array([len(b) // own.kind.itemsize for b in coded], "<u4")
            ids = np.frombuffer(b"".join(coded), own.kind)
            row = {
                "part": part,
                "seq": seq,
                "before": before,
                "n_tokens": len(ids),
                "nulls": bytes(n is None for n in names),
                "doc_ids": np.array([n or 0 for n in names], "<i8").tobytes(),
                "counts": counts.tobytes(),
                "ids": ids.tobytes(),
                "used": (used := np.flatnonzero(seen := np.bincount(ids))).astype("<u4").tobytes(),
                "times": seen[used].astype("<u4").tobytes(),
            }
            seq, before, held, names, coded = seq + 1, before + len(ids), 0, [], []
            return pa.RecordBatch.from_pylist([row], SEGMENT_ROW)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in texts)])
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + CHUNK)))
                for name, raw in zip(ids[a:b], own.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    names.append(name)
                    coded.append(raw + end)
                    held += len(raw) // own.kind.itemsize + 1
                    if held >= SEGMENT:
                        yield segment()
                a = b
        if names:
            yield segment()

    return ordered.mapInArrow(run, "part int, seq int, before long, n_tokens long, nulls binary, doc_ids binary, counts binary, ids binary, used binary, times binary")


SEGMENT_ROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("nulls", pa.binary()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("used", pa.binary()), ("times", pa.binary())])


def id_counts(found: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all segments; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for used, times in zip(batch.column(0), batch.column(1), strict=True):
                counts[np.frombuffer(used.as_buffer(), "<u4")] += np.frombuffer(times.as_buffer(), "<u4")
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])

    rows = found.select("used", "times").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in rows.toLocalIterator():
        counts[r["id"]] = r["n"]
    return counts


# --- codes -------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (0: the id does not occur), by package-merge.

    More ids than `limit` bits can tell apart raise it by as much as they need, and one.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        limit = (n - 1).bit_length() + 1
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        places = np.argsort(both, kind="stable")
        row = both[places]
        levels.append(places < n)
    taken = 2 * n - 2
    found = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        found[:own] += 1
        taken = 2 * (taken - own)
    lengths[order] = found
    return lengths


class Code:
    """Canonical codes from lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.uint8)
        self.limit = limit = int(max(lengths, default=1)) or 1
        used = np.flatnonzero(lengths)
        self.crc = zlib.crc32(self.lengths[: used[-1] + 1 if len(used) else 0].tobytes())
        self.order = used[np.argsort(lengths[used], kind="stable")]
        self.room = np.int64(1) << (limit - lengths[self.order].astype(np.int64))
        starts = np.cumsum(self.room) - self.room
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = starts >> (limit - lengths[self.order].astype(np.int64))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """id and length for every run of `limit` bits; runs that no code starts go on by one bit."""
        ids, bits = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        n = int(self.room.sum())
        ids[:n] = np.repeat(self.order, self.room)
        bits[:n] = np.repeat(self.lengths[self.order], self.room)
        return ids, bits

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(start bit of each block, codes)."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, bit = starts >> 5, starts & 31
        window = self.codes[ids] << (64 - bit - sizes).astype(np.uint64)
        n = (int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 0
        # Bits of different codes never overlap, so sums of 32-bit words are exact in doubles.
        packed = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        return starts[::BLOCK].astype("<u8"), packed.astype(">u4").tobytes()


def unpack(table: tuple[np.ndarray, np.ndarray], limit: int, starts: np.ndarray, packed: bytes, n: int, block: int) -> np.ndarray:
    """The n ids of a segment; all its blocks advance together."""
    if not n:
        return np.zeros(0, np.uint32)
    ids, bits = table
    words = np.frombuffer(packed, ">u4").astype(np.uint64)
    windows = words << np.uint64(32)
    windows[:-1] |= words[1:]
    at = starts.astype(np.int64)
    out = np.empty((min(block, n), len(at)), np.uint32)
    last, mask = len(windows) - 1, (1 << limit) - 1
    for k in range(len(out)):
        seen = windows[np.minimum(at >> 5, last)] >> (64 - limit - (at & 31)).astype(np.uint64)
        run = seen.astype(np.int64) & mask
        out[k] = ids[run]
        at += bits[run]
    return out.T.ravel()[:n]


# --- segments in their final form --------------------------------------------------------------


def to_blob(code: Code, base: int, nulls: bytes, doc_ids: bytes, counts: bytes, ids: np.ndarray) -> bytes:
    starts, packed = code.pack(ids)
    rest = nulls + doc_ids + counts + starts.tobytes() + packed
    return HEAD.pack(b"PTK1", len(nulls), len(ids), base, BLOCK, code.crc, zlib.crc32(rest)) + rest


def from_blob(blob: bytes, code_crc: int, table: tuple[np.ndarray, np.ndarray], limit: int) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(ids before the segment, doc_ids, number of ids of each, all ids)."""
    magic, n_docs, n, base, block, crc, check = HEAD.unpack_from(blob)
    rest = blob[HEAD.size :]
    if magic != b"PTK1" or crc != code_crc or check != zlib.crc32(rest):
        raise ValueError("not a segment of this code, or a damaged one")
    doc_ids = np.frombuffer(rest, "<i8", n_docs, n_docs).tolist()
    counts = np.frombuffer(rest, "<u4", n_docs, 9 * n_docs)
    n_blocks = -(-n // block)
    starts = np.frombuffer(rest, "<u8", n_blocks, 13 * n_docs)
    names = [None if rest[i] else d for i, d in enumerate(doc_ids)]
    return base, names, counts, unpack(table, limit, starts, rest[13 * n_docs + 8 * n_blocks :], n, block)


def write(docs: DataFrame, out: str, path: str, end_id: int = END_ID) -> None:
    """Encodes docs and writes them to the folder out, in the file format above."""
    spark, own = docs.sparkSession, encoder(path)
    kind, size = own.kind.str, max(own.size, end_id + 1)
    found, waiting = written_at(segments(docs, path, end_id), "segments", "zstd")
    lengths = code_lengths(id_counts(found, size))
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "length": lengths[used].astype(np.int32)})).coalesce(1).write.parquet(f"{out}/code")
    totals = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    bases, upto = {}, 0
    for part, n in totals:
        bases[part] = upto
        upto += n
    known = spark.sparkContext.broadcast((lengths, bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bases = known.value
        code = Code(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                blob = to_blob(code, bases[r["part"]] + r["before"], r["nulls"], r["doc_ids"], r["counts"], np.frombuffer(r["ids"], kind))
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([blob], pa.binary())], ["part", "seq", "blob"])

    final = found.drop("used", "times").mapInArrow(run, "part int, seq int, blob binary")
    final.withColumn("range", F.format_string("%08d", "part")).write.option("compression", "uncompressed").partitionBy("range").parquet(f"{out}/segments")
    remove(spark, waiting)


def read_code(spark: SparkSession, out: str) -> np.ndarray:
    rows = spark.read.parquet(f"{out}/code").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    return lengths


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the folder, decoded from its files."""
    known: Broadcast = spark.sparkContext.broadcast(read_code(spark, out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(known.value)
        table = code.table()
        for batch in batches:
            for blob in batch.column(0):
                base, names, counts, ids = from_blob(blob.as_buffer().to_pybytes(), code.crc, table, code.limit)
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema("seq int, blob binary, range string").parquet(f"{out}/segments")
    return files.select("blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digests(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to a new folder in the shared one, and reads the digests back from its files."""
    out = scratch(docs.sparkSession, "tokens")
    write(docs, out, path, end_id)
    return read_digests(docs.sparkSession, out)
