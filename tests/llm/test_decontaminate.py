from __future__ import annotations

import hashlib
import random
import re

import pytest

from postern.llm import decontaminate
from tests.llm.conftest import EDGES, rows


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - 9) if v else 0):
            window = v[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(21)
    vocab = ["a", "b", "cat", "dog", "é", "7", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(3, "a second text under a known id with more than ten words in it"), (None, "no id here but enough words to make a window of ten"), (40, None), (41, ""), (42, "?!"), (43, items[0][1])]
    texts = []
    for k in range(120):
        t = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = rng.randrange(len(t) + 1)
            part = (rng.choice(items)[1] or "").upper().replace(" ", rng.choice([" ", ", ", "\n"])).split(" ")
            t[p:p] = part[rng.randrange(2) :]
        texts.append((k, " ".join(t)))
    return items, [*texts, (3, texts[5][1]), (3, texts[5][1]), (None, texts[7][1]), *((r[0], r[1]) for r in EDGES)]


@pytest.mark.parametrize("block_bytes", [8_000_000, 150])
def test_hits_equal_brute_force(spark, cases, block_bytes):
    items, texts = cases
    docs = spark.createDataFrame([(*t, "x", 1, "y") for t in texts], "doc_id long, text string, spans string, copies int, items string")
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n string")
    got = rows(decontaminate.find(docs, benchmark, block_bytes=block_bytes), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((d, *brute(t, items)) for d, t in texts), key=repr)
    assert sum(r[-1] for r in got) > 20 and sum(not r[-1] for r in got) > 10
    kept = decontaminate.filter_stage(docs, benchmark, block_bytes=block_bytes, built_bytes=128_000_000 if block_bytes > 150 else 4000)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "text") == sorted(((d, t) for d, t in texts if not brute(t, items)[-1]), key=repr)


def windows(index):
    back = {v: k for k, v in index.numbers.items()}
    return {(tuple(back[x] for x in row[:n].tolist()), o) for k, (row, n) in enumerate(zip(index.windows, index.lengths.tolist())) for o in index.owners(k)}


def test_large_items_and_indexes_are_cut_between_windows(spark, cases):
    items, _ = cases
    long = [(i, t) for i, t in items if t] + [(77, " ".join(f"w{k % 91}" for k in range(1000)))]
    want = windows(decontaminate.build([(i, t.encode()) for i, t in long], 10))
    benchmark = spark.createDataFrame(long, "item_id long, text string")
    parts = list(decontaminate.blocks(benchmark, 10, 10**9, built_bytes=20_000, piece=30))
    assert len(parts) > 3 and all(p.nbytes() <= 20_000 for p in parts)
    assert set().union(*map(windows, parts)) == want


def test_hash_collisions_are_not_hits(spark, cases, monkeypatch):
    import numpy as np

    items, texts = cases
    monkeypatch.setattr(decontaminate, "mixed", lambda ids, n: np.ones(max(0, len(ids) - n + 1), np.uint64))
    index = decontaminate.build([(i, (t or "").encode()) for i, t in items], 10)
    decontaminate.pick_rarest(index, {k: np.zeros(len(h), np.int64) for k, h in index.shingles.items()})
    for _, t in texts[:40]:
        w = words(t)
        ids = np.array([index.numbers.get(x.encode(), 0) for x in w] + [0], np.uint64)
        found = {(int(b), int(k)) for _, begin, window in decontaminate.matches(index, np.array([len(w)]), ids) for b, k in zip(begin, window)}
        assert bool(found) == brute(t, items)[-1]


def test_empty(spark, docs, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(none, nothing).count() == 0
    assert {r.contaminated for r in decontaminate.find(docs, nothing).collect()} == {False}
    assert decontaminate.filter_stage(docs, nothing).count() == len(EDGES)
