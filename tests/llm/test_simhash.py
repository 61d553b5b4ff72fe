from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from postern.llm import simhash
from tests.llm.conftest import EDGES, prose


def naive(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Least member of each fingerprint's component, over all pairs."""
    u = np.unique(np.array(fps, np.uint64))
    label = np.arange(len(u))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(u ^ x) <= 3) for x in u]
    while changed:
        changed = False
        for i, n in enumerate(near):
            low = label[n].min()
            if (label[n] != low).any():
                label[n] = low
                changed = True
    return {int(x): int(u[k]) for x, k in zip(u, label)}


def flipped(rng, x, k, places=range(64)):
    for b in rng.sample(list(places), k):
        x ^= 1 << b
    return x


def grouped(spark, fps):
    """Components as sets of fingerprints, by the operator."""
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(fps)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(simhash.ball_keys(df))).collect()}
    out = {}
    for x in set(fps):
        s = int(np.uint64(x).view(np.int64))
        out.setdefault(roots.get(s, s), set()).add(x)
    return sorted(map(sorted, out.values()))


def wanted(fps):
    out = {}
    for x, k in brute_components(fps).items():
        out.setdefault(k, set()).add(x)
    return sorted(map(sorted, out.values()))


def test_fingerprints_equal_brute_force(docs):
    got = sorted(((r.doc_id, r.fp) for r in simhash.fingerprints(docs, 3).collect()), key=repr)
    assert got == sorted(((r[0], int(np.uint64(naive(r[1], 3)).view(np.int64))) for r in EDGES), key=repr)
    for width in (1, 2, 5):
        for text in ("a", "a b", "a b c d e", "B b b b b b", prose(1, 30)):
            assert simhash.fingerprint(text.encode(), width) == naive(text, width)


def test_links_of_every_distance_and_place(spark):
    """Pairs at exactly 3, 2, 1 and 4 bits, spread over blocks in every way."""
    rng, fps = random.Random(9), []
    blocks = [range(a, a + n) for a, n in simhash.BLOCKS]
    for _ in range(40):
        for k in (1, 2, 3, 4):
            x = rng.getrandbits(64)
            fps += [x, flipped(rng, x, k)]
            for b in blocks:
                x = rng.getrandbits(64)
                fps += [x, flipped(rng, x, min(k, 3), b)]
        x = rng.getrandbits(64)
        fps += [x, x ^ sum(1 << rng.choice(list(b)) for b in blocks)]
    fps += [0, (1 << 64) - 1, 1 << 63, 7]
    assert grouped(spark, fps) == wanted(fps)


def test_chains_stars_and_crowds(spark):
    rng, fps = random.Random(11), []
    x = rng.getrandbits(64)
    for _ in range(120):  # a path whose ends are far apart
        x = flipped(rng, x, 3)
        fps.append(x)
    centre = rng.getrandbits(64)
    fps += [flipped(rng, centre, rng.randint(1, 3)) for _ in range(400)]
    base = rng.getrandbits(64)
    fps += [base ^ (rng.getrandbits(21) << 43) for _ in range(2500)]  # one key with many members
    assert grouped(spark, fps) == wanted(fps)


def test_lookups_equal_comparisons():
    """The two ways of linking members of one key agree."""
    rng = random.Random(13)
    fps = np.unique(np.array([rng.getrandbits(17) << 5 for _ in range(2300)], np.uint64))
    key = 0
    edges = simhash.bucket_edges(fps, key, 0)
    forest, brute = simhash.Forest(), simhash.Forest()
    for a, b in edges:
        assert (np.bitwise_count(a ^ b) <= 3).all()
        for x, y in zip(a.tolist(), b.tolist()):
            forest.join(x, y)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 3].tolist():
            brute.join(int(x), y)
    assert len(fps) > 2048 and all(forest.root(x) == brute.root(x) for x in fps.tolist())


def test_classes_equal_brute_force(docs, none):
    got = simhash.classes(docs, 3).collect()
    comp = brute_components([naive(r[1], 3) for r in EDGES])
    least = {}
    for d, t, *_ in EDGES:
        if d is not None:
            k = comp[naive(t, 3)]
            least[k] = min(least.get(k, d), d)
    want = sorted(((d, least.get(comp[naive(t, 3)])) for d, t, *_ in EDGES), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == want
    assert simhash.classes(none).count() == 0


def test_one_component_per_group_of_copies(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text for a third of all rows here' ELSE concat('row ', id, ' has words ', id * 7, ' of its own ', id * 13) END AS text")
    got = simhash.classes(df, 3)
    assert got.where("doc_id % 3 = 0").select("component_id").distinct().collect() == [(0,)]
    assert got.count() == 3000
