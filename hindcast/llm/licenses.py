"""License scans by template-markup matching.

A template is license wording with two kinds of markup: `[[ ... ]]` encloses an optional region and
`{{n}}` stands for a replaceable region of at most n words. Each template is compiled into an
automaton over tokens (position automaton: one state for each token, follow sets across optional and
replaceable regions), kept as bit masks. A text is accepted where every mandatory word of a template
stands in order with nothing else between than the markup allows. Automata run only from places where
one of their first words stands, and end as soon as no state is alive. Words are looked up by hash, and those of
a match compared as text. A replaceable region at a template's beginning proves nothing: such a template
starts at the first word behind it.

Base labels come from four fixed phrases whose words stand consecutively. Template labels name what
the wording says exactly. Null and empty texts have no words; texts are read whole; repeated rows give
repeated results; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_slices, table, texts
from .textvec import WORD, Words, hash_words, words

# Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Wording that several templates share.
_WARRANTY = "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details"
_AS_IS = (
    "this software is provided by {{10}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or"
    " profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this"
    " software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above"
    " copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "[[3]] neither the name of {{10}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GNU = "{{8}} is free software [[you can]] redistribute it and or modify it under the terms of the {name} as published by the free software foundation"


def gnu(name: str, version: str, later: bool) -> str:
    """The notice that the texts of the GNU licenses recommend, for one name and version."""
    terms = f"either version {version} of the license or [[at your option]] any later version" if later else f"version {version} [[of the license]]"
    return f"{_GNU} {terms} {{{{8}}}} is distributed in the hope that it will be useful but {_WARRANTY}".replace("{name}", name)


# Templates, each with the label that it proves.
TEMPLATES = (
    ("gpl-notice", "[[this work is]] [[this program is]] licensed under the gnu general public license version {{3}}"),
    ("gpl-notice", _GNU.replace("{name}", "gnu general public license")),
    ("gpl-2.0-or-later", gnu("gnu general public license", "2", True)),
    ("gpl-2.0-only", gnu("gnu general public license", "2", False)),
    ("gpl-3.0-or-later", gnu("gnu general public license", "3", True)),
    ("gpl-3.0-only", gnu("gnu general public license", "3", False)),
    ("lgpl-2.1-or-later", gnu("gnu lesser general public license", "2 1", True)),
    ("lgpl-3.0-or-later", gnu("gnu lesser general public license", "3", True)),
    ("agpl-3.0-or-later", gnu("gnu affero general public license", "3", True)),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[{{10}}]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "[[this {{3}} is]] licensed under the [[terms of the]] mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{6}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{6}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]]"),
    ("isc-text", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-text", _BSD),
    ("bsd-2-clause", f"{_BSD} {_AS_IS}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_AS_IS}"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "distributed under the boost software license version 1 0 [[{{16}}]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{8}}]]"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2 0 which [[accompanies this distribution and]] is available at {{8}}"),
    ("cc0-1.0", "to the extent possible under law {{10}} waived all copyright and related or neighboring rights to {{10}}"),
    ("cc-by-notice", "licensed under [[a]] [[the]] [[creative commons attribution]] cc by {{2}}"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
)


class TokenAutomaton:
    """A position automaton over token ids; masks are Python integers, so any template length fits."""

    def __init__(self, markup: str, ids: dict[str, int]):
        items, self.any = [], 0
        self.at: dict[int, int] = {}
        pieces = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup.lower())
        depth_start: list[int] = []
        optional: list[tuple[int, int]] = []
        for piece in pieces:
            if piece == "[[":
                depth_start.append(len(items))
            elif piece == "]]":
                optional.append((depth_start.pop(), len(items)))
            elif piece.startswith("{{"):
                for _ in range(int(piece[2:-2])):
                    optional.append((len(items), len(items) + 1))
                    items.append(None)
            else:
                items.append(piece)
        n = len(items)
        # skips[i]: positions reachable from the gap before item i without reading a word
        skips = [{i} for i in range(n + 1)]
        for i in range(n, -1, -1):
            for a, b in optional:
                if a == i:
                    skips[i] |= skips[b]
        for p, item in enumerate(items):
            if item is None:
                self.any |= 1 << p
            else:
                self.at[ids[item]] = self.at.get(ids[item], 0) | 1 << p
        self.follow = [sum(1 << q for q in skips[p + 1] if q < n) for p in range(n)]
        self.begin = sum(1 << q for q in skips[0] if q < n)
        self.accept = sum(1 << p for p in range(n) if n in skips[p + 1])
        self.first = sorted({ids[items[q]] for q in skips[0] if q < n and items[q] is not None})

    def run(self, tokens: np.ndarray, start: int, end: int) -> int:
        """The end of the longest accepted run of tokens from start, or -1."""
        live, found, pos = self.begin, -1, start
        while live and pos < end:
            live &= self.at.get(int(tokens[pos]), 0) | self.any
            if live & self.accept:
                found = pos + 1
            reach, rest = 0, live
            while rest:
                low = rest & -rest
                reach |= self.follow[low.bit_length() - 1]
                rest ^= low
            live, pos = reach, pos + 1
        return found


class Scanner:
    """All automata over one shared vocabulary."""

    def __init__(self):
        vocabulary = sorted({t for _, m in TEMPLATES for t in re.findall(r"[a-z0-9]+", re.sub(r"\{\{\d+\}\}", " ", m))} | {t for p, _ in PHRASES for t in p.split()})
        ids = {t: i for i, t in enumerate(vocabulary)}
        self.names = vocabulary
        hashes = hash_words(vocabulary)
        order = np.argsort(hashes)
        self.sorted, self.ids = hashes[order], order
        self.automata = [(label, TokenAutomaton(m, ids)) for label, m in TEMPLATES]
        self.starts = {t for _, a in self.automata for t in a.first}
        self.phrases = [([ids[t] for t in p.split()], label) for p, label in PHRASES]

    def tokens(self, w: Words) -> np.ndarray:
        """The vocabulary id of each word, -1 for all others."""
        at = np.minimum(np.searchsorted(self.sorted, w.hash), len(self.sorted) - 1)
        return np.where(self.sorted[at] == w.hash, self.ids[at], -1)

    def scan(self, w: Words) -> dict[int, tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
        """By text: base places and template places, as (first word, end word, label)."""
        tokens = self.tokens(w)
        doc = w.doc_of()
        found: dict[int, tuple[list, list]] = {}
        for phrase, label in self.phrases:
            hit = np.flatnonzero(tokens == phrase[0])
            hit = hit[hit + len(phrase) <= len(tokens)]
            for k, token in enumerate(phrase):
                hit = hit[(tokens[hit + k] == token) & (doc[hit + k] == doc[hit])]
            for i in hit.tolist():
                if all(w.text(i + k) == self.names[t] for k, t in enumerate(phrase)):
                    found.setdefault(int(doc[i]), ([], []))[0].append((i, i + len(phrase), label))
        for label, automaton in self.automata:
            for token in automaton.first:
                for i in np.flatnonzero(tokens == token).tolist():
                    d = int(doc[i])
                    end = automaton.run(tokens, i, int(w.first[d + 1]))
                    if end > 0 and all(tokens[k] < 0 or w.text(k) == self.names[tokens[k]] for k in range(i, end)):
                        found.setdefault(d, ([], []))[1].append((i, end, label))
        return found


@functools.cache
def scanner() -> Scanner:
    """The scanner of a Python worker, which serves all of its tasks."""
    return Scanner()


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.string())]
)


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: labels, places of the base phrases, and template places (label:first:end)."""

    def scan(part: pa.RecordBatch) -> dict:
        w = words(part.column("text"))
        n = part.num_rows
        out: dict[str, list] = {
            "doc_id": part.column("doc_id").to_pylist(), "n_words": np.diff(w.first).tolist(), "n_base": [0] * n, "first_word": [None] * n,
            "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "places": [""] * n,
        }
        for d, (base, more) in scanner().scan(w).items():
            first = int(w.first[d])
            labels = {x[2] for x in base}
            out["n_base"][d] = len(base)
            if base:
                out["first_word"][d] = min(x[0] for x in base) - first
                out["last_word"][d] = max(x[0] for x in base) - first
            out["base_labels"][d] = ",".join(sorted(labels))
            out["labels"][d] = ",".join(sorted(labels | {x[2] for x in more}))
            # a matched template is proof; a bare phrase is a hint that each further one supports
            out["score"][d] = 1.0 if more else 1.0 - 0.5 ** len(base)
            out["places"][d] = ",".join(f"{label}:{a - first}:{b - first}" for a, b, label in sorted(more))
        return out

    return map_slices(texts(docs), scan, _SCHEMA, _ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


__all__ = ["PHRASES", "TEMPLATES", "WORD", "Scanner", "TokenAutomaton", "licenses", "query"]
