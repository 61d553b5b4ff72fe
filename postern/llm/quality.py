"""Quality rules: base statistics of a text and compression bands.

A document is rejected by the base rules (too few words, or over half of them in repeated
three-word windows), or by its compression.  zstandard's ratio (compressed / original UTF-8
bytes) is taken of the whole text and of each fixed chunk.  Prose of a given length compresses
into a known band: below it the text repeats itself, above it the text is noise (encoded or
encrypted data).  Short texts compress less, so the limits go by length, for chunks as for texts.
Texts too short for sixteen of the fixed chunks are also cut into finer ones, so that encoded
data beside prose is seen in them; texts below two of the finest (256 bytes) have no chunk test.
Hexadecimal digits compress like prose and are not told from it.

Null and empty texts have no words, all counts are 0, and they fail the base rules.  Every input
row gives one output row, so repeated rows and null ids stay as they are.  Other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """limits: (texts below this many bytes, least ratio, greatest ratio), the last for all others.

    A text of at least two chunks is also rejected if more than bad_share of its bytes lie in
    chunks outside of chunk_low to chunk_high.  A text of fewer than sixteen chunks is cut once
    more, into the greatest of `finer` that gives sixteen, or the least; chunks of these are
    judged by `fine_limits`, which read like limits and end where chunk_low and chunk_high begin.
    """

    level: int = 3
    limits: tuple[tuple[float, float, float], ...] = (
        (128, 0.50, 1.10),
        (160, 0.48, 0.97),
        (200, 0.46, 0.93),
        (256, 0.44, 0.89),
        (512, 0.40, 0.95),
        (1024, 0.48, 0.85),
        (2048, 0.44, 0.80),
        (4096, 0.425, 0.75),
        (8192, 0.405, 0.72),
        (16384, 0.39, 0.70),
        (32768, 0.375, 0.68),
        (131072, 0.33, 0.66),
        (float("inf"), 0.25, 0.65),
    )
    chunk: int = 2048
    chunk_low: float = 0.32
    chunk_high: float = 0.70
    bad_share: float = 0.4
    finer: tuple[int, ...] = (1024, 512, 256, 128)
    fine_limits: tuple[tuple[float, float, float], ...] = (
        (192, 0.42, 0.97),
        (384, 0.38, 0.86),
        (768, 0.36, 0.80),
        (1536, 0.34, 0.75),
    )

    def band(self, size: int) -> tuple[float, float]:
        return next((low, high) for top, low, high in self.limits if size < top)

    def cuts(self, size: int) -> list[int]:
        """Lengths of the chunks that a text of this many bytes is cut into, one after the other."""
        fine = [c for c in self.finer if c < self.chunk]
        out = [self.chunk]
        if fine and size < 16 * self.chunk:
            out.append(next((c for c in fine if size >= 16 * c), fine[-1]))
        return [c for c in out if size >= 2 * c]

    def chunk_band(self, size: int, cut: int) -> tuple[float, float]:
        if cut < self.chunk:
            for top, low, high in self.fine_limits:
                if size < top:
                    return low, high
        return self.chunk_low, self.chunk_high


class _Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice, its first place included."""
    n = len(words)
    if n < 4:
        return 0
    seen = _Ids()
    ids = np.array([seen[w] for w in words], np.int64)
    if len(seen) == n:
        return 0
    # Pairs are numbered first, so that a key of two numbers below 2**31 always fits into 63 bits.
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + n - 2] |= twice
    return int(hit.sum())


def base_statistics(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    solid = raw.translate(None, SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(solid.decode("utf-8", "replace")), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def in_band(raw: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole-text ratio, share of bytes in chunks out of band (the greater of both cuts), and whether both are within limits."""
    size = len(raw)
    if not size:
        return 0.0, 0.0, False
    low, high = bands.band(size)
    ratio = len(squeeze.compress(raw)) / size
    worst = 0
    for cut in bands.cuts(size):
        bad = 0
        # The last chunk takes the remainder, so that no chunk is shorter than the others.
        starts = range(0, size - size % cut, cut)
        ends = [*starts[1:], size]
        for a, b in zip(starts, ends, strict=True):
            least, most = bands.chunk_band(b - a, cut)
            if not least <= len(squeeze.compress(raw[a:b])) / (b - a) <= most:
                bad += b - a
        worst = max(worst, bad)
    return ratio, worst / size, low <= ratio <= high and worst <= bands.bad_share * size


def judge(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, compression ratios, base_failed and kept.

    A map over the texts: nothing is shuffled, and a batch is the most that is in memory.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunk_share double, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for raw in batch.column(1).cast(pa.binary()):
                raw = raw.as_py() or b""
                n, chars, symbols, lines, repeats = base_statistics(raw)
                failed = n < 50 or 100 * repeats > 50 * n
                ratio, bad, fits = in_band(raw, bands, squeeze)
                rows.append((n, chars, symbols, lines, repeats, ratio, bad, failed, fits and not failed))
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "zstd_ratio", "bad_chunk_share", "base_failed", "kept"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def filter_stage(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            keep = []
            for raw in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()):
                raw = raw.as_py() or b""
                words = raw.split()
                keep.append(len(words) >= 50 and in_band(raw, bands, squeeze)[2] and 100 * repeated_words(words) <= 50 * len(words))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
