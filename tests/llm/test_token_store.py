from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postern.llm import token_store as ts

from tests.llm.conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = ts.Encoder(PATH)


def direct(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


ALPHABET = list("ab. ,'\n\t0é漢²½\xa0 　İ😀_") + ["  ", " \n", "\r\n", "'s", "'ll", "<|endoftext|>", "word", " Word", "ñandú", "ǅ", "ª", "\x1c", "ͅ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), max_size=5))
def test_encoder_equals_the_tokenizer(texts):
    assert [np.frombuffer(b, ENCODER.kind).tolist() for b in ENCODER.encode(texts)] == [direct(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.kind).tolist() == direct(text)


def test_encoder_forgets_and_stays_right():
    own = ts.Encoder(PATH)
    own.REMEMBERED = 50
    rng = random.Random(4)
    for _ in range(20):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 250) + rng.choice(["", ",", "."]) for _ in range(12)) for _ in range(4)]
        assert [np.frombuffer(b, own.kind).tolist() for b in own.encode(texts)] == [direct(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["word", "é", "½", "7", "漢", "ʰ", "'s", "'", "!", "?!", ")", "_", "$$$", "...", " ", "\n", "  ", "<|endoftext|>"]), max_size=14).map("".join), max_size=5))
def test_marks_behind_words(texts):
    own = ts.Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(b, own.kind).tolist() for b in own.encode(texts)] == [direct(t) for t in texts]


def test_pieces_are_looked_up_once_and_words_learned_without_marks():
    class Counting(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    own = ts.Encoder(PATH)
    own.known = Counting()
    texts = ["so a word\nand a word! word?! 12) word$$$ ünd!"] * 40
    assert [np.frombuffer(b, own.kind).tolist() for b in own.encode(texts)] == [direct(t) for t in texts]
    assert own.known.asked == 10
    assert {"word", "12", "ünd", "\n!", "\n?!", "\n)", "\n$$$"} <= own.known.keys()


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(5)
    for _ in range(60):
        counts = np.array([rng.choice([0, 1, 2, 3, 10, 1000, 10**9]) for _ in range(rng.randint(2, 60))])
        loose = ts.code_lengths(counts, 40).astype(int)
        if (counts > 0).sum() > 1:
            assert int((loose * counts).sum()) == huffman_cost(counts[counts > 0].tolist())
        tight = ts.code_lengths(counts, 6).astype(int)
        assert tight.max(initial=0) <= 6 and sum(2.0 ** -x for x in tight if x) <= 1 and ((tight > 0) == (counts > 0)).all()
    assert ts.code_lengths(np.ones(1 << 9, int), 8).max() == 9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.integers(0, 5))
def test_blocks_decode(ids, skew):
    ids = np.array([i if i % (skew + 1) == 0 else 0 for i in ids], np.uint32)
    code = ts.Code(ts.code_lengths(np.bincount(ids, minlength=41)))
    starts, packed = code.pack(ids)
    assert len(starts) == -(-len(ids) // ts.BLOCK)
    assert np.array_equal(ts.unpack(code.table(), code.limit, starts, packed, len(ids), ts.BLOCK), ids)
    # Any block decodes by itself from its checkpoint.
    for k in range(len(starts)):
        part = ids[k * ts.BLOCK : (k + 1) * ts.BLOCK]
        assert np.array_equal(ts.unpack(code.table(), code.limit, starts[k : k + 1], packed, len(part), ts.BLOCK), part)


def test_damaged_segments_are_noticed():
    ids = np.arange(50, dtype=np.uint32)
    code = ts.Code(ts.code_lengths(np.bincount(ids)))
    blob = bytearray(ts.to_blob(code, 7, b"\0", np.array([3], "<i8").tobytes(), np.array([50], "<u4").tobytes(), ids))
    base, names, counts, got = ts.from_blob(bytes(blob), code.crc, code.table(), code.limit)
    assert (base, names, counts.tolist(), got.tolist()) == (7, [3], [50], ids.tolist())
    blob[-3] ^= 1
    with pytest.raises(ValueError):
        ts.from_blob(bytes(blob), code.crc, code.table(), code.limit)


def test_files_hold_every_document_in_order(spark, docs):
    got = sorted(ts.digests(docs, PATH).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r[0] is not None, r[0] or 0) for r in EDGES)
    want, upto = {}, 0
    for d, t, *_ in EDGES:
        ids = np.array([*direct(t or ""), 2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == upto
        upto += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_many_segments(spark, monkeypatch):
    df = spark.range(300).select((F.lit(500) - F.col("id")).alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    got = sorted(ts.digests(df, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(201, 501)) and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_empty(none):
    assert ts.digests(none, PATH).count() == 0


def test_equal_rows_are_dealt_over_ranges(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("if(id % 2 = 0, 7, id) AS doc_id", "'the same text' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = {r.part: len(r.nulls) for r in ts.segments(df, PATH).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held.values()) == 4000 and max(held.values()) < 2000
    got = sorted(ts.digests(df, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([7] * 2000 + list(range(1, 4000, 2))) and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
