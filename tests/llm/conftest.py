"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

import pytest

LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing about spring and rivers carry cold water down from distant hills towards the quiet sea where old boats wait for wind".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "s", "ed", ","]) + (".\n" if rng.random() < 0.08 else "") for _ in range(n)).replace("\n ", "\n")


EDGES = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n\r\x0b\x0c ", None, "b", 7),
    (None, "a row without an id", "fr", None, 1),
    (None, None, None, None, None),
    (5, "twice", "en", "b", 5),
    (5, "twice", "en", "b", 5),
    (5, "the same id, another text", "en", "b", 5),
    (6, "Ünïcödé ÅÄÖ 漢字 😀 İ a\xa0b", "de", "ä", 5),
    (7, LONG, "en", "b", len(LONG)),
    (8, "<|im_end|><|endoftext|>  x\n\n y", "en", "c", 5),
    (9, "7 8 9 , . ! ?", "en", "c", 5),
    (-4, "twice", "en", "c", 5),
    (2**62, "TWICE", "en", "c", 5),
    *((100 + i, prose(i, 40 + 9 * i), ("en", "fr")[i % 2], "abc"[i % 3], 0) for i in range(30)),
    (200, prose(3, 67), "en", "a", 0),
    (201, prose(3, 67) + " more", "en", "a", 0),
]
EXTRA = ["size", "shard", "kept", "fp", "n_words", "bucket", "copies", "__size", "n", "ids", "text_hash"]


@pytest.fixture(scope="session")
def docs(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *("clash" for _ in EXTRA)) for r in EDGES], kind).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


def rows(df, *columns):
    """Rows as sorted tuples; nulls compare."""
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(found, key=repr)
