from __future__ import annotations

import math
import random
import zlib

import numpy as np

from postern.llm import language_id as lid
from tests.llm.conftest import EDGES

SYLLABLES = {"xa": ["ba", "lo", "mi", "ter"], "xb": ["schn", "ung", "öl", "ach"], "xc": ["que", "ción", "ella", "í"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_backpropagation_equals_finite_differences():
    net, rng = lid.Network(3, hidden=4), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows = rng.integers(60, 70, (5, 6)).astype(np.uint8)
    mask = np.ones((5, 6), bool)
    mask[0, 4:] = False
    labels = np.array([0, 1, 2, 0, 1])
    _, g = net.gradients(windows, mask, labels)
    for k, v in net.p.items():
        for _ in range(4):
            i = tuple(rng.integers(n) for n in v.shape)
            if k == "x":
                i = (int(windows[1, rng.integers(6)]) + 256 * int(rng.integers(2)), int(rng.integers(12)))
            v[i] += 1e-3
            up = net.gradients(windows, mask, labels)[0]
            v[i] -= 2e-3
            down = net.gradients(windows, mask, labels)[0]
            v[i] += 1e-3
            assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3 * max(1.0, abs(g[k][i]))


def test_pooling_covers_every_position():
    net = lid.Network(3)
    rng = random.Random(1)
    texts = [text(rng, "xa", n).encode() for n in (1, 5, 9, 40, 3000)]
    got = lid.pooled(net, texts)
    for raw, p in zip(texts, got):
        probs = net.probabilities(lid.windows_of(raw)).transpose(1, 0, 2).reshape(-1, 3)[: len(raw)]
        assert np.allclose(p, probs.mean(0), atol=1e-4) and abs(p.sum() - 1) < 1e-3


def test_held_out_accuracy_and_fold(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(600))]
    # Labels of the held-out fold are wrong on purpose: they must never be learned from.
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = spark.createDataFrame([(i, t, "xa" if out(i) else lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in lid.identify(docs).collect()}
    assert all(got[i].held_out == out(i) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if out(i)]) > 0.97
    again = {r.doc_id: r.lang_pred for r in lid.identify(docs.repartition(5)).collect()}
    assert all(again[i] == got[i].lang_pred for i in again)


def test_sample_is_bounded_and_comes_from_whole_texts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat('ab cd ', 200), 'the end of text ', id) AS text", "if(id % 3 = 0, 'xa', 'xb') AS lang")
    got = lid.sample(docs, per_language=50, windows=400)
    assert 700 < len(got) <= 800 and all(len(t) <= lid.WINDOW for t, _ in got)
    assert any(b"the end of text" in t for t, _ in got) and len({lang for _, lang in got}) == 2
    everything = lid.sample(docs.where("doc_id < 40"), per_language=50, windows=10_000)
    whole = {r.doc_id: r.text.encode() for r in docs.where("doc_id < 40").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert sorted(t for t, _ in everything) == sorted(raw[a : a + lid.WINDOW] for raw in whole.values() for a in range(0, len(raw), lid.WINDOW))
    assert len(lid.sample(docs, per_language=50, windows=400, most=30)) == 30


def test_any_number_of_languages(spark):
    """More labels than a bounded sample has room for; each is learned, and predictions are among them."""
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('text number ', id) AS text", "concat('lang ', id % 150) AS lang")
    langs, net = lid.train(lid.sample(docs, most=100), steps=2)
    assert len(langs) == 150 == len(net.p["b"])
    assert {r.lang_pred for r in lid.predict(docs, langs, net).collect()} <= set(langs)


def plain_probabilities(p, raw):
    """The network written out for one window, number by number."""
    h = p["c"].shape[1]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    states = []
    for way, places in ((0, range(len(raw))), (1, range(len(raw) - 1, -1, -1))):
        state, mine = [0.0] * h, {}
        for t in places:
            x = p["x"][raw[t] + 256 * way]
            gate = [sigmoid(x[j] + sum(state[i] * p["u"][way][i][j] for i in range(h))) for j in range(2 * h)]
            past = [sum(state[i] * p["c"][way][i][j] for i in range(h)) for j in range(h)]
            new = [math.tanh(x[2 * h + j] + gate[h + j] * past[j]) for j in range(h)]
            state = [new[j] + gate[j] * (state[j] - new[j]) for j in range(h)]
            mine[t] = state
        states.append(mine)
    out = []
    for t in range(len(raw)):
        logits = [p["b"][k] + sum(states[w][t][i] * p["o"][w][i][k] for w in (0, 1) for i in range(h)) for k in range(len(p["b"]))]
        total = sum(math.exp(x) for x in logits)
        out.append([math.exp(x) / total for x in logits])
    return out


def test_predictions_equal_a_plain_forward_pass():
    net, rng = lid.Network(4), random.Random(3)
    for raw in (b"a", text(rng, "xb", 2).encode(), text(rng, "xc", 40).encode()):
        rows = []
        for a in range(0, len(raw), lid.WINDOW):
            padded = raw[a : a + lid.WINDOW].ljust(lid.WINDOW, b"\0")
            rows += plain_probabilities(net.p, padded)[: len(raw) - a]
        assert np.allclose(lid.pooled(net, [raw])[0], np.mean(rows, axis=0), atol=1e-4)


def test_edges(docs, none):
    got = lid.identify(docs).collect()
    assert len(got) == len(EDGES)
    letters = {(r[0], r[1] is not None and any(c.isalpha() for c in r[1])) for r in EDGES}
    und = sorted((repr(r.doc_id) for r in got if r.lang_pred == "und"))
    assert und == sorted(repr(r[0]) for r in EDGES if not (r[1] and any(c.isalpha() for c in r[1]))) and letters
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0) for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert lid.identify(none).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).where("lang IS NULL")
    assert {r.lang_pred for r in lid.identify(unlabelled).collect()} == {"und"}
