"""The pipeline against a brute-force version of every stage, and the registration of all queries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from postern.llm import quality, queries
from tests.llm.conftest import EDGES, prose
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_mixing import brute_copies
from tests.llm.test_quality import brute as base
from tests.llm.test_near_dedup import brute_kept, signed

ITEMS = [(1, prose(9001, 25)), (2, prose(9002, 12)), (3, "five words are quite few")]


def corpus():
    rng, out = random.Random(12), list(EDGES)
    for i in range(60):
        t = prose(500 + i % 45, 70 + 3 * (i % 45))
        if i % 11 == 0:
            t += " " + ITEMS[i % 2][1]
        if i % 13 == 0:
            t = ("again and again " * 60).strip()
        out.append((1000 + i, t, "en", rng.choice("abcd"), len(t)))
    # Ids that are null or repeat, with equal and other texts, and rows that repeat as a whole.
    for i, t in enumerate((prose(700, 120), prose(700, 120), prose(701, 150), prose(702, 90))):
        out.append((None, t, None, None, None))
        out += [(1003, t, "fr", None, 3)] * (1 + i % 2)
    return out


def brute_pipeline(docs):
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    kept = [d for d in docs if not base(d[1])[-1] and quality.in_band((d[1] or "").encode(), quality.Bands(), squeeze)[2]]
    least = brute_kept(kept)
    clean = [d for d in least.values() if not contamination(d[1], ITEMS)[-1]]
    mixed = [d for d, c in zip(clean, brute_copies(clean, 3, "qsssq")) for _ in range(c)]
    tokenizer, upto, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d in sorted(mixed, key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1]))):
        ids = np.array([*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d[0], upto, len(ids), zlib.crc32(ids.tobytes())))
        upto += len(ids)
    return [len(kept), len(least), len(clean), len(mixed)], out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts, want = brute_pipeline(docs)
    assert len(docs) > counts[0] > counts[1] > counts[2] > 5
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        if n < 4:
            assert frame.columns == [c.split(" ")[0] for c in kind.split(", ")], name
            seen.append(frame.count())
    assert seen == counts
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = queries.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
