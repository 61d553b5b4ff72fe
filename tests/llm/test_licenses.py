from __future__ import annotations

import random
import time
from fractions import Fraction

from postern.llm import licenses
from postern.llm.decontaminate import words_of
from tests.llm.conftest import EDGES, prose


def pairs(text):
    w = words_of(text.encode())
    return set(zip(w, w[1:]))


def brute(text, templates, t=Fraction(4, 5)):
    """Every passage of both kinds against every template, by sets and fractions; overlaps go to the better one."""
    words, line_of = [], []
    for i, x in enumerate(text.split("\n")):
        mine = words_of(x.encode())
        words += mine
        line_of += [i] * len(mine)
    grams = list(zip(words, words[1:]))
    covered, out = set(), {}
    for whole_lines in (True, False):
        found = []
        for k, (name, body) in enumerate(templates):
            b, length = pairs(body), len(words_of(body.encode()))
            hits = [h for h, g in enumerate(grams) if g in b]
            if whole_lines:
                lines = sorted({line_of[w] for h in hits for w in (h, h + 1)})
                spans = [(line_of.index(n), len(line_of) - line_of[::-1].index(n)) for n in lines]
            else:
                free = [h for h in hits if h not in covered and h + 1 not in covered]
                spans = [(h, 1 + next(e for e in range(h + 1, len(words) + 1) if e not in free)) for h in free if h - 1 not in free]
            for i, (first, _) in enumerate(spans):
                for _, end in spans[i:]:
                    a = set(grams[first : end - 1])
                    size = len(a) + (0 if whole_lines else max(0, length - (end - first)))
                    score = Fraction(2 * len(a & b), size + len(b))
                    if score >= t:
                        found.append((-score, first, end, name, b))
        for score, first, end, name, b in sorted(found, key=lambda x: x[:4]):
            if not covered & set(range(first, end)):
                covered |= set(range(first, end))
                whole = Fraction(2 * len(set(grams) & b), len(set(grams)) + len(b)) >= t
                out.setdefault(name, (name, float(-score), line_of[first], line_of[end - 1] + 1 - line_of[first], whole))
    return [out[n] for n in sorted(out)]


def some_texts():
    rng, texts = random.Random(4), []
    notices = [x for x in licenses.TEMPLATES if len(x[1]) < 700]
    for i in range(140):
        lines = [prose(100 * i + k, rng.randint(0, 8)) for k in range(rng.randint(0, 6))]
        for _ in range(rng.randrange(3)):
            _, body = rng.choice(notices)
            w = body.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(["changed", "words", w[0]])
            step = rng.choice([1000, 12, 5])
            lines[rng.randrange(len(lines) + 1) : 0] = [" ".join(w[a : a + step]) for a in range(0, len(w), step)] * rng.choice([1, 1, 3])
        texts.append(rng.choice(["\n", "\n", " "]).join(lines))
    return texts


def test_scans_equal_brute_force(spark):
    texts = some_texts()
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.TEMPLATES).collect()
    got: dict = {}
    for r in rows:
        if r.license:
            got.setdefault(r.doc_id, []).append((r.license, r.dice, r.first_line, r.n_lines, r.whole_text))
    want = {i: f for i, t in enumerate(texts) if (f := brute(t, licenses.TEMPLATES))}
    assert got == want and len(want) > 40


def test_a_coefficient_of_exactly_the_threshold_matches():
    scanner = licenses.Scanner((("Proprietary", "All rights reserved."),), 0.8)
    assert [x[:2] for x in scanner.scan(b"All rights reserved. All")] == [("Proprietary", 0.8)]
    assert list(scanner.passages([(b"all", b"rights"), (b"rights", b"reserved"), (b"reserved", b"all")], {(b"all", b"rights"), (b"rights", b"reserved")}, [(0, 4)])) == [(0.8, 0, 4)]


def test_a_long_text_that_repeats_a_notice():
    """A megabyte of one notice, in lines and in one line, is one license and no more work than another text."""
    scanner = licenses.Scanner(licenses.TEMPLATES + licenses.TEXTS, licenses.THRESHOLD)
    for joint in (b"\n", b" "):
        raw = joint.join([b"This work is licensed under the GNU General Public License, version 3."] * 14_000)
        began = time.process_time()
        found = scanner.scan(raw)
        assert [x[:2] for x in found] == [("GPL-3.0", 1.0 if joint == b"\n" else 22 / 23)]
        assert time.process_time() - began < 20


def test_one_line_belongs_to_one_license(spark):
    body = "x\nThis work is licensed under the GNU General Public License, version 3.\nAll rights reserved.\ny y"
    got = {r.license: r for r in licenses.scan(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()}
    assert set(got) == {"GPL-3.0", "Proprietary"} and got["GPL-3.0"].dice == 1.0 and (got["GPL-3.0"].first_line, got["GPL-3.0"].n_lines) == (1, 1)
    whole = licenses.scan(spark.createDataFrame([(1, licenses.TEMPLATES[4][1])], "doc_id long, text string")).first()
    assert whole.license == "MIT" and whole.whole_text


def test_edges(docs, none):
    got = licenses.scan(docs).collect()
    assert len(got) == len(EDGES) and all(r.license is None for r in got)
    assert licenses.scan(none).count() == 0


def names(text):
    scanner = licenses.Scanner(licenses.TEMPLATES + licenses.TEXTS, licenses.THRESHOLD)
    return {name: (round(dice, 3), first, n) for name, dice, first, n, _ in scanner.scan(text.encode())}


def test_notices_within_lines():
    assert names("Copyright 2024 Acme Inc. All rights reserved.") == {"Proprietary": (1.0, 0, 1)}
    assert names("This article is licensed under CC BY 4.0.") == {"CC-BY-4.0": (1.0, 0, 1)}
    for name, body in licenses.TEMPLATES:
        assert name in names(f"{prose(1, 90)}\n{prose(2, 60)} {body} {prose(3, 60)}"), body
    two = names(f"{prose(4, 80)} Licensed under CC BY-SA 4.0. {prose(5, 50)} Released under the MIT License.")
    assert two == {"CC-BY-SA-4.0": (1.0, *two["CC-BY-SA-4.0"][1:]), "MIT": (1.0, *two["MIT"][1:])}


def test_notices_and_texts_have_their_own_names():
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
    for kind, version, name in (("", 2, "GPL-2.0"), ("", 3, "GPL-3.0"), ("Lesser ", 3, "LGPL-3.0"), ("Affero ", 3, "AGPL-3.0")):
        assert names(gnu.format(kind, version)) == {name: (1.0, 0, 1)}
    for name, body in licenses.TEXTS:
        assert names(body)[name][0] == 1.0
        assert names(" ".join(body.split()))[name][0] == 1.0
