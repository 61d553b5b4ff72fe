from __future__ import annotations

import math
import random
import re
import struct
from collections import defaultdict

import xxhash

from postern.llm import mixing
from tests.llm.conftest import EDGES, EXTRA, rows


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, share=1.5, most=2.0):
    """By the contract's words: share by weight, stop at the top, share the excess anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = {s: share * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in order}
    full = set()
    while over := {s for s in order if s not in full and target[s] > most * sizes[s] + 1e-9}:
        excess = sum(target[s] - most * sizes[s] for s in over)
        full |= over
        rest = [s for s in order if s not in full]
        for s in over:
            target[s] = most * sizes[s]
        for s in rest:
            target[s] += excess * weight[s] / sum(weight[r] for r in rest)
    return target


def brute_rates(sizes, target, base=1.5, most=2.0):
    """Rates of documents of these sizes by bisection of the multiplier."""
    if not sum(sizes) or target >= most * sum(sizes) * (1 - 1e-12):
        return [(most if sum(sizes) else base) for _ in sizes]
    rate = lambda m, x: min(most, base * math.exp(min(700.0, m * x)))
    low, high = -50.0, 50.0
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(x * rate(middle, x) for x in sizes) < target else (low, middle)
    return [rate(high, x) for x in sizes]


def spark_hash(values, kinds):
    """XXH64 of a row, 63 bits; kinds: q (long), i (int), s (string) by column."""
    h = 42
    for v, k in zip(values, kinds, strict=True):
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if k == "s" else struct.pack(f"<{k}", v), h)
    return h & (1 << 63) - 1


def brute_copies(docs, source_at, kinds):
    """Rows with id and text in front -> copies, by the rule as it is stated, one document after another.

    Among equal rows the first ones are taken once more.
    """
    mine = defaultdict(list)
    for i, d in enumerate(docs):
        mine[d[source_at]].append(i)
    size = [size_of(d[1]) for d in docs]
    targets = brute_targets({s: sum(size[i] for i in own) for s, own in mine.items()})
    out = [0] * len(docs)
    for s, own in mine.items():
        rates = dict(zip(own, brute_rates([size[i] for i in own], targets[s]), strict=True))
        for i in own:
            out[i] = math.floor(rates[i] + 1e-9)
        lack = max(0.0, targets[s] - sum(out[i] * size[i] for i in own))
        hashes = {i: spark_hash(docs[i], kinds) for i in own}
        able = [i for i in own if size[i] and out[i] + 1 <= 2]
        u = lambda i: (hashes[i] + 1) / 2**63  # noqa: E731, B023
        broken = lambda i: rates[i] - out[i]  # noqa: E731, B023
        drawn = sorted((i for i in able if broken(i) > 1e-9), key=lambda i: (u(i) / (u(i) + broken(i)), hashes[i], size[i]))
        left = set(able)
        for i in drawn:
            if size[i] > lack:
                break
            out[i] += 1
            lack -= size[i]
            left.discard(i)
        for i in sorted(left, key=lambda i: (-size[i], hashes[i])):
            if size[i] <= lack:
                out[i] += 1
                lack -= size[i]
    return out


MADE = "qsssi"


def make(spark, docs):
    return spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, source string, target string, copies int")


def brute_made(docs):
    return brute_copies([(*d, "x", 7) for d in docs], 2, MADE)


def random_docs(n=500, seed=5):
    rng = random.Random(seed)
    names = ["s0", "s1", "Z", "ä", None, "only short", "empty"]
    docs = []
    for i in range(n):
        s = "s0" if rng.random() < 0.4 else rng.choice(names)
        k = 0 if s == "empty" else rng.randint(0, 3) if s == "only short" else int(rng.paretovariate(0.8) * 5) % 900
        docs.append((i, " ".join(["w"] * k), s))
    return docs


def words_by_source(docs, got):
    source, taken, target, smallest = {d[0]: d[2] for d in docs}, defaultdict(int), {}, {}
    for r in got:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] += r.taken
        target[s] = r.target
        if r["size"] and r.copies < 2:
            smallest[s] = min(smallest.get(s, 10**9), r["size"])
    return taken, target, smallest


def near(docs, got):
    """No source is above its target, and none lacks what a document that could be taken once more has."""
    taken, target, smallest = words_by_source(docs, got)
    for s, t in target.items():
        assert taken[s] <= t + 1e-6
        assert t - taken[s] < smallest.get(s, 1e-6 * t + 1e-6)


def test_targets_equal_the_contract(spark):
    rng = random.Random(8)
    for _ in range(5):
        sizes = {s: rng.choice([0, 1, 7, 50, 1000, 20000]) for s in rng.sample(["a", "b", "B", "é", "漢", "", None, "zz"], rng.randint(1, 8))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = brute_targets(sizes)
        got = {r.source: r for r in mixing.targets(df).collect()}
        assert got.keys() == want.keys()
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        for s, r in got.items():
            assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.sid == order.index(s)


def test_rates_solve_the_dual(spark):
    # Targets of a, b and c are about 1.75, 0.8 and 1.85 times their sizes.
    docs = [(i, " ".join(["w"] * (1 + i * 7 % 61)), "aaabbcc"[i % 7]) for i in range(700)]
    mine = defaultdict(list)
    for _, t, s in docs:
        mine[s].append(size_of(t))
    targets = brute_targets({s: sum(x) for s, x in mine.items()})
    want = {(s, x): r for s, sizes in mine.items() for x, r in zip(sizes, brute_rates(sizes, targets[s]), strict=True)}
    assert any(r < 1 for r in want.values()) and any(1.5 < r < 2 for r in want.values())
    source = {d[0]: d[2] for d in docs}
    for r in mixing.mix(make(spark, docs)).collect():
        assert abs(r.rate - want[source[r.doc_id], r["size"]]) < 1e-6


def test_copies_equal_brute_force(spark):
    docs = random_docs() + [(7, "a b c", "s1"), (7, "a b c", "s1"), (None, "a b", "Z"), (None, None, "Z")]
    got = mixing.mix(make(spark, docs)).collect()
    want = sorted(((d[0], size_of(d[1]), c * size_of(d[1])) for d, c in zip(docs, brute_made(docs))), key=repr)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got), key=repr) == want


def test_sources_come_near_their_targets(spark):
    docs = random_docs(2500, 6)
    got = mixing.mix(make(spark, docs)).collect()
    near(docs, got)
    again = mixing.mix(make(spark, docs[::-1]).repartition(7))
    assert rows(again, "doc_id", "taken", "rate") == sorted(((r.doc_id, r.taken, r.rate) for r in got), key=repr)


def test_many_small_sources(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.randint(1, 40)), f"source {i % 120}") for i in range(120 * 60)]
    near(docs, mixing.mix(make(spark, docs)).collect())


def test_equal_rows_are_taken_by_number(spark, monkeypatch):
    """A third of a source is one row, and the draw may end in it, at each level of the histograms."""
    monkeypatch.setattr(mixing, "SMALL_ROWS", 3)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    for seed in range(2):
        rng = random.Random(seed)
        docs = [(i, " ".join(["w"] * rng.randint(1, 30)), "ab"[i % 2]) for i in range(200)]
        docs += [(1000 + seed, "one two three four five six seven", "a")] * 150 + [(2000, "one two three", "b")] * 90
        df = make(spark, docs)
        got = mixing.mix(df).collect()
        near(docs, got)
        want = brute_made(docs)
        assert sorted((r.doc_id, r.taken) for r in got) == sorted((d[0], c * size_of(d[1])) for d, c in zip(docs, want))
        assert rows(mixing.mix_stage(df), "doc_id", "source") == sorted(((d[0], d[2]) for d, c in zip(docs, want) for _ in range(c)), key=repr)


def test_stage_repeats_rows(spark, docs, none):
    want = brute_copies([(*r, *("clash" for _ in EXTRA)) for r in EDGES], 3, "qsssq" + "s" * len(EXTRA))
    out = mixing.mix_stage(docs)
    assert out.columns == docs.columns
    assert rows(out, "doc_id", "text") == sorted(((r[0], r[1]) for r, c in zip(EDGES, want) for _ in range(c)), key=repr)
    assert mixing.mix(docs).count() == len(EDGES)
    assert mixing.mix(none).count() == 0 and mixing.mix_stage(none).count() == 0


def test_texts_without_words(spark):
    docs = make(spark, [(1, None, "a"), (2, " ", "a"), (3, "", None)])
    assert rows(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken") == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]
