from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from postern.llm import chat_format

PARTS = ["<", "|", "\\", "<|", "|>", "<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "im_end", "\n", "é", "😀", "ok", " ", "%", "%0A", "assistant", "<|im_start|>assistant\n"]
KIND = "conv_id long, turn long, role string, text string, formatted string, turns string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        # Strings go by UTF-8 bytes.
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        told = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_hostile_texts_and_roles_come_back(spark):
    rng, rows = random.Random(1), []
    for i in range(900):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))
        role = rng.choice(["user", "assistant", "system", "".join(rng.choice(PARTS) for _ in range(3))])
        rows.append((i // 7, i % 3, role, text, "x", "y"))
    formatted = chat_format.format_chats(spark.createDataFrame(rows, KIND))
    got = chat_format.read_back(formatted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows)
    for r in formatted.collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == sum(x[0] == r.conv_id for x in rows)
        for s in r.loss_spans:
            assert r.formatted[: s.start].endswith("<|im_start|>assistant\n") and r.formatted[s.start + s.length :].startswith("<|im_end|>\n")


def test_nulls_ties_repeats_and_long(spark):
    rows = [(1, 0, None, None, "", ""), (1, 0, None, None, "", ""), (1, None, "assistant", "first", "", ""), (None, 1, "assistant", "x", "", ""), (None, 0, "user", None, "", ""), (2, 5, "assistant", "é" * 300_000, "", "")]
    got = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, KIND))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows)


def test_plain_texts_are_left_as_they_are(spark):
    rows = [(1, 0, "user", "a <|b|> <| im_end |> \\ %", "", "")]
    assert chat_format.format_chats(spark.createDataFrame(rows, KIND)).first().formatted == "<|im_start|>user\na <|b|> <| im_end |> \\ %<|im_end|>\n"


def test_bad_grammar_is_null(spark):
    bad = ["x", "<|im_start|>user\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>user\na<|im_end|>"]
    df = spark.createDataFrame([(b,) for b in bad], "f string")
    assert df.select(chat_format.parse(df.f).alias("t")).where("t IS NOT NULL").count() == 0


def test_empty(spark):
    assert chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], KIND))).count() == 0
