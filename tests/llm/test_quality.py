from __future__ import annotations

import base64
import random
import re
from collections import Counter

import zstandard

from postern.llm import quality

from tests.llm.conftest import EDGES, LONG, prose, rows


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts_equal_brute_force(docs):
    got = rows(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((r[0], *brute(r[1])) for r in EDGES), key=repr)


def test_random_texts():
    rng = random.Random(7)
    for _ in range(300):
        t = "".join(rng.choice(["a ", "b ", "a\n", "#", "\n", "é ", "\x0b", "b b a "]) for _ in range(rng.randrange(60)))
        assert (*quality.base_statistics(t.encode()),) == brute(t)[:5]


def test_bands(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=-_:;!?") for _ in range(9)) for _ in range(3000))
    phrase = " ".join(f"{a}{b}" for a in "abcdefgh" for b in range(9))
    natural = " ".join("".join(rng.choice(["th", "er", "in", "on", "an", "re", "ed", "st", "ou", "ng", "a", "e", "o"]) for _ in range(rng.randint(1, 4))) for _ in range(1500))
    half = natural + "".join(f" {phrase} {i}" for i in range(60))
    df = spark.createDataFrame(list(enumerate([natural, noise, (phrase + " ") * 30, half])), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[0].kept and not got[0].base_failed
    assert not got[1].kept and not got[1].base_failed and got[1].zstd_ratio > 0.7
    assert not got[2].kept and not got[3].kept and got[3].bad_chunk_share > 0.4
    assert [r.doc_id for r in quality.filter_stage(df).collect()] == [0]


#: The limits once more, as a table of their own: (below so many bytes, least, greatest).
WHOLE = [(128, 0.50, 1.10), (160, 0.48, 0.97), (200, 0.46, 0.93), (256, 0.44, 0.89), (512, 0.40, 0.95), (1024, 0.48, 0.85), (2048, 0.44, 0.80), (4096, 0.425, 0.75), (8192, 0.405, 0.72)]
WHOLE += [(16384, 0.39, 0.70), (32768, 0.375, 0.68), (131072, 0.33, 0.66), (1 << 60, 0.25, 0.65)]
FINE = [(192, 0.42, 0.97), (384, 0.38, 0.86), (768, 0.36, 0.80), (1536, 0.34, 0.75), (1 << 60, 0.32, 0.70)]


def ratio(raw):
    return len(zstandard.compress(raw, 3)) / len(raw)


def within(x, size, table):
    _, least, greatest = min(row for row in table if size < row[0])
    return least <= x <= greatest


def brute_verdict(text):
    """By the docstrings, chunk by chunk, without the module's functions and figures."""
    raw = (text or "").encode()
    n = len(raw)
    if not n or brute(text)[-1] or not within(ratio(raw), n, WHOLE):
        return False
    cuts = [2048] if n >= 4096 else []
    if n < 32768 and n >= 256:
        cuts += [max(c for c in (128, 256, 512, 1024) if n >= 16 * c or c == 128)]
    for cut in cuts:
        chunks = [raw[i * cut : (i + 1) * cut] for i in range(n // cut)]
        chunks[-1] = raw[(n // cut - 1) * cut :]
        bad = sum(len(c) for c in chunks if not within(ratio(c), len(c), FINE if cut < 2048 else FINE[-1:]))
        if bad > 0.4 * n:
            return False
    return True


def test_verdicts_equal_brute_force(spark, docs):
    rng, texts = random.Random(6), [r[1] for r in EDGES]
    for i in range(250):
        words = prose(i, rng.choice([55, 60, 90, 200, 700, 3000])).split(" ")
        if i % 3 == 0:  # short words, for texts of few bytes
            words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 3]))) for _ in words[:60]]
        if i % 4 == 1:
            a = rng.randrange(len(words))
            words[a : a + len(words) // 2] = [base64.b64encode(rng.randbytes(rng.choice([40, 300, 2000]))).decode()]
        if i % 5 == 2:
            words += words[: len(words) // 3] * rng.randint(1, 3)
        texts.append(" ".join(words))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: brute_verdict(t) for i, t in enumerate(texts)}
    assert got == want and 40 < sum(want.values()) < 240
    assert {len((t or "").encode()) // 128 for t in texts} >= {0, 1, 2, 3, 8}


def test_chunks_cover_the_text():
    bands = quality.Bands(limits=((float("inf"), 0.0, 2.0),), chunk=100, chunk_low=0, chunk_high=0, bad_share=2.0)
    for n in (199, 200, 201, 299, 1000):
        assert quality.in_band(b"x" * n, bands, zstandard.ZstdCompressor())[1] == (1.0 if n >= 200 else 0.0)


def test_stage_keeps_columns_and_rows(docs, none):
    kept = quality.filter_stage(docs)
    assert kept.columns == docs.columns
    judged = [r.doc_id for r in quality.judge(docs).collect() if r.kept]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(judged)
    assert quality.judge(none).count() == quality.filter_stage(none).count() == 0
    assert len(LONG) > 100_000 and len(prose(1, 5)) > 5


def test_encoded_data_beside_prose():
    """Texts of every length of which half is base64 have too many chunks out of band; the prose alone has none."""
    rng, squeeze, bands = random.Random(3), zstandard.ZstdCompressor(level=3), quality.Bands()
    parts = ["th", "er", "in", "on", "an", "re", "ed", "st", "ou", "ng", "a", "e", "o"]
    for size in (1500, 3500, 6000, 14_000, 60_000, 300_000):
        words = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(size // 3)).encode()
        blob = base64.b64encode(rng.randbytes(size))
        assert quality.in_band(words[:size], bands, squeeze)[1] == 0.0
        for text in (words[: size // 2] + b" " + blob[: size // 2], blob[: size // 2] + b" " + words[: size // 2]):
            assert len(text.split()) >= 50
            assert quality.in_band(text, bands, squeeze)[1] > 0.4, size
