"""License scans: passages compared with license templates by the Dice coefficient over word bigrams.

Texts and templates are normalised to words: A-Z lower-cased, digits kept, all other ASCII taken
as blanks.  The Dice coefficient of a passage A and a template B is 2 |A and B| / (|A| + |B|) over
their sets of bigrams; a passage matches from `threshold` = t on.  Then

* the sizes bound each other: t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|, and templates whose
  size does not fit are not compared;
* a text that holds a matching passage holds at least t / (2 - t) * |B| of the template's
  bigrams, and texts that do not are left out for that template.

Both follow from the threshold, so nothing that matches is lost.  Passages are of two kinds: all
runs of whole lines that begin and end with a line that holds one of the template's bigrams, and,
for a notice within a longer line, all runs of words that begin where the text goes over from
other words to the template's bigrams and end where it leaves them.  To begin or end elsewhere never
raises the coefficient: a bigram of the template more adds to both sets, another one only to the
passage's.  So that a notice with its ends cut off does not gain by it, a run of words shorter than
the template counts a bigram more for each word that it lacks.  A text can join lines freely, so
bigrams of a passage go across its line ends.

Licenses are worded alike, so each word is given to one of them: passages are taken in the order of
their coefficients (ties: the earlier, the shorter, then by name), whole lines before words, and
those that overlap one taken before are passed over.  What whole lines match is thus reported with
the whole lines' coefficient.

One row per document and license found in it, or one row with a null license: the id, the license,
the best coefficient over its passages, the number of the first line of the best passage (from 0),
its number of lines, and whether the text as a whole is the license.  Null and empty texts have none.  Repeated rows and null ids
are documents like others.  Other columns are not read.  The templates are handed to every task;
they are a fixed list, and `MOST_TEMPLATES` bounds any other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from fractions import Fraction
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.decontaminate import words_of

THRESHOLD = 0.8
MOST_TEMPLATES = 5000



def _gnu(work: str, kind: str, version: str, mark: str | None) -> str:
    """The Free Software Foundation's notice; without a mark, of this version only."""
    granted = f"GNU {kind}General Public License"
    if mark:
        granted += f" as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."
    else:
        granted += f" version {version} as published by the Free Software Foundation."
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {granted} This {work} is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        f"{kind}General Public License for more details."
    )


_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors "
    "may be used to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: License notices and texts as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors "
        "may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-2.0", _gnu("program", "", "2", ";")),
    ("GPL-2.0", _gnu("program", "", "2", None)),
    ("LGPL-2.1", _gnu("library", "Lesser ", "2.1", ";")),
    ("LGPL-3.0", _gnu("library", "Lesser ", "3", ",")),
    ("LGPL-3.0", _gnu("program", "Lesser ", "3", ",")),
    ("AGPL-3.0", _gnu("program", "Affero ", "3", ",")),
    ("BSD-2-Clause", _BSD_2 + " " + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + " " + _BSD_3 + " " + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to "
        "https://unlicense.org/",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _text(name: str) -> str:
    return (files("postern.llm") / "license_texts" / f"{name}.txt").read_text("utf-8")


def _affero(gpl: str) -> str:
    """The AGPL's text: the GPL's with another name, first paragraph and section 13."""
    head, _, rest = gpl.partition("13. Use with the GNU Affero General Public License.")
    _, _, tail = rest.partition("14. Revised Versions")
    rename = lambda x: x.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    kind = "software and other kinds of works"
    return (
        rename(head).replace(f"{kind}.", f"{kind}, specifically designed to ensure cooperation with the community in the case of network server software.", 1)
        + "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, "
        "your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such "
        "interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server "
        "at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding "
        "Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding "
        "any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General "
        "Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is "
        "the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License. 14. Revised Versions"
        + rename(tail)
    )


#: The same licenses' full texts.
TEXTS: tuple[tuple[str, str], ...] = (
    *((name, _text(name)) for name in ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")),
    ("AGPL-3.0", _affero(_text("GPL-3.0"))),
)

Bigram = tuple[bytes, bytes]


def bigrams(words: list[bytes]) -> set[Bigram]:
    return set(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float) -> None:
        self.templates = [(name, bigrams(words_of(text.encode()))) for name, text in templates]
        self.lengths = [len(words_of(text.encode())) for _, text in templates]
        # Whole numbers decide, so that a coefficient of exactly the threshold matches.
        exact = Fraction(str(threshold))
        self.over, self.under = exact.numerator, exact.denominator
        self.any = set().union(*(b for _, b in self.templates)) if self.templates else set()
        self.by_bigram: dict[Bigram, list[int]] = {}
        for k, (_, own) in enumerate(self.templates):
            for b in own:
                self.by_bigram.setdefault(b, []).append(k)

    def matches(self, shared: int, size: int, template: int) -> bool:
        return 2 * shared * self.under >= self.over * (size + template)

    def enough(self, size: int, template: int) -> bool:
        """size >= t / (2 - t) * template; with its arguments exchanged, size <= (2 - t) / t * template."""
        return size * (2 * self.under - self.over) >= self.over * template

    def candidates(self, words: list[bytes]) -> list[int]:
        """Templates of which the text holds enough bigrams."""
        shared: dict[int, int] = {}
        for b in self.any.intersection(zip(words, words[1:], strict=False)):
            for k in self.by_bigram[b]:
                shared[k] = shared.get(k, 0) + 1
        return sorted(k for k, n in shared.items() if self.enough(n, len(self.templates[k][1])))

    def passages(self, pairs: list[Bigram], template: set[Bigram], spans: list[tuple[int, int]], length: int = 0) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first word, end) of passages that match, from the begin of a span to the end of one; words short of length count.

        Of passages that begin alike, one that ends later is given only if it is better: else it is never
        taken, because it overlaps all that the earlier one does.  So only ends matter that bring a new
        bigram or are still short of length, and a text that repeats itself is not gone through again and
        again: from the last begin to the first, `ahead` keeps the bigrams in the order of their next places.
        """
        ends, most = [end for _, end in spans], len(template)
        ahead: OrderedDict[Bigram, int] = OrderedDict()  # the nearest last
        at, left = len(pairs), 0
        for first, _ in reversed(spans):
            while at > first:
                at -= 1
                left += pairs[at] in template and pairs[at] not in ahead
                ahead[pairs[at]] = at
                ahead.move_to_end(pairs[at])
            if not self.enough(left, most):  # too few of the template's bigrams are left
                continue
            nearest = iter(reversed(ahead.items()))
            coming = next(nearest, None)
            found = shared = 0
            best, i = 0.0, bisect_right(ends, first)
            while i < len(ends):
                end = ends[i]
                while coming and coming[1] <= end - 2:
                    found += 1
                    shared += coming[0] in template
                    coming = next(nearest, None)
                if not self.enough(most, found):  # too large already
                    break
                size = found + max(0, length - (end - first))
                score = 2 * shared / (size + most)
                if score > best and self.matches(shared, size, most):
                    best = score
                    yield score, first, end
                if end - first < length:
                    i += 1
                elif shared == left or not coming:
                    break
                else:
                    i = max(i + 1, bisect_left(ends, coming[1] + 2))

    def scan(self, raw: bytes) -> list[tuple[str, float, int, int, bool]]:
        """(license, coefficient, first line, lines, whole) of every license found, by name."""
        words = words_of(raw)
        asked = self.candidates(words)
        if not asked:
            return []
        pairs = list(zip(words, words[1:], strict=False))
        own = set(pairs)
        line_of: list[int] = []
        bounds: dict[int, tuple[int, int]] = {}  # (first word, end) of lines with words
        for i, x in enumerate(raw.split(b"\n")):
            if n := len(words_of(x)):
                bounds[i] = (len(line_of), len(line_of) + n)
                line_of += [i] * n
        out: dict[str, tuple[str, float, int, int, bool]] = {}
        covered = bytearray(len(words))

        def take(spans_of: dict[int, list[tuple[int, int]]], whole_lines: bool) -> None:
            found = []
            for k, spans in spans_of.items():
                name, template = self.templates[k]
                found += [(-score, first, end, name, k) for score, first, end in self.passages(pairs, template, spans, 0 if whole_lines else self.lengths[k])]
            found.sort()
            for score, first, end, name, k in found:
                if not any(covered[first:end]):
                    covered[first:end] = b"\1" * (end - first)
                    template = self.templates[k][1]
                    whole = self.matches(len(own & template), len(own), len(template))
                    at = line_of[first]
                    out.setdefault(name, (name, -score, at, line_of[end - 1] + 1 - at, whole))

        hits = {k: [i for i, pair in enumerate(pairs) if pair in self.templates[k][1]] for k in asked}
        take({k: [bounds[i] for i in sorted({line_of[j] for h in at for j in (h, h + 1)})] for k, at in hits.items()}, True)
        # Then within lines: bigrams that touch no word taken, in runs.
        runs: dict[int, list[tuple[int, int]]] = {}
        for k, at in hits.items():
            for h in at:
                if covered[h] or covered[h + 1]:
                    continue
                mine = runs.setdefault(k, [])
                if mine and mine[-1][1] == h + 1:
                    mine[-1] = (mine[-1][0], h + 2)
                else:
                    mine.append((h, h + 2))
        take(runs, False)
        return [out[name] for name in sorted(out)]


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """id, license, dice, first_line, n_lines, whole_text; a map over the texts."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; they are handed to every task, which takes {MOST_TEMPLATES} at most")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows, found = [], []
            for i, raw in enumerate(batch.column(1).cast(pa.binary())):
                for hit in scanner.scan(raw.as_py() or b"") or [(None, None, None, None, False)]:
                    rows.append(i)
                    found.append(hit)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], [id_col, "license", "dice", "first_line", "n_lines", "whole_text"])

    return docs.select(F.col(id_col), F.col("text").cast("string")).mapInArrow(run, f"`{id_col}` {kind}, license string, dice double, first_line long, n_lines long, whole_text boolean")
