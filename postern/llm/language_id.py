"""Language identification by a bidirectional gated recurrent network over bytes.

The text's UTF-8 bytes are cut into windows of `WINDOW`.  Over each window two gated recurrent
units run, one forwards and one backwards, and both states together label every position with a
probability for each language; a document's probabilities are the means over all its positions.
The network is trained here, in numpy, by backpropagation through time on all positions of
sampled windows, with Adam.

Learning looks only at text and lang of documents whose crc32(doc_id as text) mod 4 is not 2 and
whose lang is not null.  The sample is bounded twice: at most `PER_LANGUAGE` documents of each language,
those with the least hashes of doc_id, are cut into windows from begin to end, and of the windows of a
language at most `WINDOWS` are learned from, those with the least hashes, wherever in a text they lie.
With so many languages that these would be more than `MOST_WINDOWS`, each has its share, one at least; every
language that occurs is learned.  Predictions read the whole of every text.
The sample and the seed are fixed, so reruns agree.

A null text, or one without a letter, is `und` with score 0; so is every text if there was nothing
to learn from.  A null doc_id is not held out and never learned from.  Every input row gives one
output row.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postern.llm.common import remove, written_at

PER_LANGUAGE = 600
WINDOWS = 2400
MOST_WINDOWS = 400_000
WINDOW = 64
HIDDEN = 8
STEPS = 160
LANES = 256
#: Windows that are labelled side by side, unless there are very many languages.
WIDTH = 2048
#: Probabilities (windows x positions x languages) that are held at a time.
HELD = 1 << 23

_LATIN = re.compile(rb"[A-Za-z]")


def held_out(df: DataFrame, id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, most: int = MOST_WINDOWS) -> list[tuple[bytes, str]]:
    """(window of a text, its language), a bounded number."""
    scale = 1_000_000
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(docs))
    known = known.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").cast("binary").alias("raw"))

    def least(rows: DataFrame, keys: list[str], sizes: DataFrame, quota: int) -> DataFrame:
        """At most quota rows of each lang.

        Over twice the quota by hash first, so that what is ranked is small however large a language is.  sizes
        (lang, total) is a table, whose size Spark knows: it is broadcast if it is small, and rows meet it unshuffled.
        """
        rate = F.floor(F.lit(scale * (2.0 * quota + 20)) / F.col("total")) + 1
        hashed = rows.join(sizes.withColumnRenamed("lang", "__lang"), F.col("lang") == F.col("__lang")).withColumn("h", F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(scale)))
        order = F.row_number().over(Window.partitionBy("lang").orderBy("h", *keys))
        return hashed.where(F.col("h") < rate).withColumn("n", order).where(F.col("n") <= quota).drop("__lang", "total", "h", "n")

    sizes, sizes_path = written_at(known.groupBy("lang").agg(F.count("*").alias("total")), "language-sizes")
    chosen, path = written_at(least(known, ["doc_id", "raw"], sizes, per_language), "languages")
    remove(docs.sparkSession, sizes_path)
    n_windows = F.ceil(F.octet_length("raw") / F.lit(WINDOW)).cast("int")
    cut = chosen.where(n_windows > 0).select("lang", "doc_id", "raw", F.explode(F.sequence(F.lit(0), n_windows - 1)).alias("at"))
    cut = cut.select("lang", "doc_id", "at", F.substring("raw", F.col("at") * WINDOW + 1, F.lit(WINDOW)).alias("part"))
    sizes, sizes_path = written_at(chosen.groupBy("lang").agg(F.sum(n_windows).alias("total")).where("total > 0"), "language-sizes")
    quota = max(1, min(windows, most // max(1, sizes.count())))
    rows = least(cut, ["doc_id", "at", "part"], sizes, quota).select("part", "lang").collect()
    for used in (sizes_path, path):
        remove(docs.sparkSession, used)
    return sorted((bytes(r["part"]), r["lang"]) for r in rows)


def windows_of(raw: bytes) -> np.ndarray:
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    """Two gated recurrent units and a softmax over both states.

    With x a byte's row of the input table, per direction: z, r = sigmoid(x + h U); the candidate
    c = tanh(x + r * (h U)); h' = c + z * (h - c).  The input tables of both directions are
    stacked, so one look-up serves both.
    """

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h = hidden
        self.h = h
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {
            "x": small(512, 3 * h),
            "u": small(2, h, 2 * h),
            "c": small(2, h, h),
            "o": small(2, h, n_out),
            "b": np.zeros(n_out, np.float32),
        }

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after every step, (steps, 2, lanes, hidden); step t of the backward unit is position -1 - t."""
        n, steps = windows.shape
        h2, p = 2 * self.h, self.p
        index = np.stack([windows, windows[:, ::-1].astype(np.int32) + 256]).astype(np.int32)
        index = np.ascontiguousarray(index.transpose(2, 0, 1))
        state = np.zeros((2, n, self.h), np.float32)
        out = np.empty((steps, 2, n, self.h), np.float32)
        for t in range(steps):
            x = p["x"].take(index[t], axis=0)
            gates = np.matmul(state, p["u"])
            gates += x[..., :h2]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., : self.h], gates[..., self.h :]
            past = np.matmul(state, p["c"])
            new = r * past
            new += x[..., h2:]
            np.tanh(new, out=new)
            before, state = state, new + z * (state - new)
            out[t] = state
            if keep is not None:
                keep.append((index[t], before, z, r, past, new))
        return out

    def logits(self, states: np.ndarray) -> np.ndarray:
        """(positions, lanes, languages)"""
        return states[:, 0] @ self.p["o"][0] + states[::-1, 1] @ self.p["o"][1] + self.p["b"]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = self.logits(self.states(windows))
        out -= out.max(-1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(-1, keepdims=True)
        return out

    def gradients(self, windows: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions under the mask, and its gradients, backwards through time."""
        keep: list = []
        states = self.states(windows, keep)
        logits = self.logits(states)
        logits -= logits.max(-1, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(-1, keepdims=True)
        lanes, total = np.arange(len(labels)), mask.sum()
        loss = float((-np.log(probs[:, lanes, labels] + 1e-9) * mask.T).sum() / total)
        probs[:, lanes, labels] -= 1
        probs *= (mask.T / total)[..., None].astype(np.float32)
        p, h = self.p, self.h
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["b"] = probs.sum((0, 1))
        g["o"][0] = np.tensordot(states[:, 0], probs, ((0, 1), (0, 1)))
        g["o"][1] = np.tensordot(states[::-1, 1], probs, ((0, 1), (0, 1)))
        above = np.stack([probs @ p["o"][0].T, probs[::-1] @ p["o"][1].T], 1)
        back = np.zeros_like(states[0])
        for t in range(len(states) - 1, -1, -1):
            index, before, z, r, past, new = keep[t]
            back = back + above[t]
            d_new = back * (1 - z) * (1 - new * new)
            d_z = back * (before - new) * z * (1 - z)
            d_past = d_new * r
            d_r = d_new * past * r * (1 - r)
            gates = np.concatenate([d_z, d_r], -1)
            g["u"] += np.matmul(before.transpose(0, 2, 1), gates)
            g["c"] += np.matmul(before.transpose(0, 2, 1), d_past)
            np.add.at(g["x"], index.ravel(), np.concatenate([gates, d_new], -1).reshape(-1, 3 * h))
            back = back * z + np.matmul(gates, p["u"].transpose(0, 2, 1)) + np.matmul(d_past, p["c"].transpose(0, 2, 1))
        return loss, g


def train(examples: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 5) -> tuple[list[str], Network]:
    """Languages and a network, by Adam over windows drawn evenly from the languages."""
    languages = sorted({lang for _, lang in examples})
    pools = []
    for lang in languages:
        parts = [raw for raw, x in examples if x == lang and raw]
        pools.append(np.concatenate([windows_of(raw) for raw in parts]) if parts else np.zeros((1, WINDOW), np.uint8))
    net, rng = Network(len(languages), seed=seed), np.random.default_rng(seed)
    lanes = max(8, min(LANES, HELD // (WINDOW * len(languages))))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        labels = rng.integers(len(languages), size=lanes)
        windows = np.stack([pools[k][rng.integers(len(pools[k]))] for k in labels])
        mask = windows > 0
        mask[:, 0] = True
        _, g = net.gradients(windows, mask, labels)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.03 * min(1.0, step / 10) * (1 - 0.9 * step / steps) * min(1.0, 1.0 / (norm + 1e-9))
        for k, x in g.items():
            first[k] += 0.1 * (x - first[k])
            second[k] += 0.01 * (x * x - second[k])
            net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return languages, net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; texts must not be empty."""
    sums = np.zeros((len(texts), len(net.p["b"])))
    width = max(8, min(WIDTH, HELD // (WINDOW * len(net.p["b"]))))
    waiting, owners, held = [], [], 0

    def label() -> None:
        nonlocal waiting, owners, held
        windows, owner = np.concatenate(waiting), np.concatenate(owners)
        for a in range(0, len(windows), width):
            part, own = windows[a : a + width], owner[a : a + width]
            probs = net.probabilities(part)
            # Only a text's last window is padded, and padding is at its end.
            real = np.arange(WINDOW)[:, None] < lengths[a : a + width][None, :]
            np.add.at(sums, own, np.einsum("tlk,tl->lk", probs, real))
        waiting, owners, held = [], [], 0

    sizes: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    for i, raw in enumerate(texts):
        w = windows_of(raw)
        waiting.append(w)
        owners.append(np.full(len(w), i))
        size = np.full(len(w), WINDOW)
        size[-1] = len(raw) - WINDOW * (len(w) - 1)
        sizes.append(size)
        held += len(w)
        if held >= 8 * width or i == len(texts) - 1:
            lengths = np.concatenate(sizes)
            sizes = []
            label()
    return sums / np.array([max(1, len(t)) for t in texts])[:, None]


def has_letter(raw: bytes) -> bool:
    return bool(_LATIN.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(docs: DataFrame, languages: list[str], net: Network | None, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, lang_pred and score of every row; a map over the texts."""
    known = docs.sparkSession.sparkContext.broadcast((languages, net))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = known.value
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(2).cast(pa.binary())]
            asked = [i for i, t in enumerate(texts) if own is not None and has_letter(t)]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if asked:
                probs = pooled(own, [texts[i] for i in asked])
                best = probs.argmax(1)
                for i, k in zip(asked, best.tolist(), strict=True):
                    langs[i] = names[k]
                scores[asked] = np.clip(probs[np.arange(len(best)), best], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), held_out(docs, id_col).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    examples = sample(docs)
    languages, net = train(examples) if examples else ([], None)
    return predict(docs, languages, net)
