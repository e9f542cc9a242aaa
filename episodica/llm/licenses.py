"""License scans as an exact set-similarity join.

A template is the set of its two-word shingles; a block is any run of consecutive words of a document, as long as
the template and half as much, ``block_words`` at least. A block joins a template if it holds at least ``threshold`` of
the template's shingles. Shingles are ordered by how often the whole corpus has them, the rarest first: a text that
lacks all of a template's first |T| - need + 1 shingles cannot hold ``need`` of them (prefix filter), nor can one with
fewer shingles of the template (length filter), nor one with too few left behind the first shared one (positional
filter). What passes is counted exactly over all blocks by a sliding window, so the result is that of comparing every
block, wherever it starts, with every template.

The templates are a parameter of bounded size and travel with the tasks; documents are not shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, pick, text_or_empty

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public notices and license texts, and their labels, as words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
)
THRESHOLD = 0.8
#: A block's words, at least, and for each word of its template.
BLOCK_WORDS, BLOCK_SHARE = 64, 1.5
MOST_TEMPLATES = 10_000

#: A to Z in lower case; other ASCII that is no letter or digit becomes a space; the rest stays.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LETTERS).split()


def shingles_of(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every word index at which the phrase's words stand one after the other."""
    out, n, k = [], len(phrase), -1
    while True:
        try:
            k = words.index(phrase[-1], max(k + 1, n - 1))
        except ValueError:
            return out
        if words[k - n + 1 : k + 1] == phrase:
            out.append(k - n + 1)


class Index:
    """Templates by the shingles of their prefixes."""

    def __init__(self, templates, threshold: float, frequency: dict[tuple[bytes, bytes], int], block_words: int):
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        sets = [shingles_of(x) for x in texts]
        # Of shingles that are as rare, those with a long last word come first: few texts have it.
        order = sorted({s for x in sets for s in x}, key=lambda s: (frequency.get(s, 0), -len(s[1]), s))
        self.rank = {s: i for i, s in enumerate(order)}
        self.sets = [sorted(self.rank[s] for s in x) for x in sets]
        self.of = [set(x) for x in self.sets]
        self.need = [max(1, math.ceil(threshold * len(x) - 1e-9)) for x in self.sets]
        self.block = [max(block_words, math.ceil(BLOCK_SHARE * len(x))) for x in texts]
        self.by_rank: dict[int, list[tuple[int, int]]] = {}
        for t, (x, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for i, r in enumerate(x[: len(x) - need + 1]):
                self.by_rank.setdefault(r, []).append((t, i))
        self.second = {order[r][1] for r in self.by_rank}

    def candidates(self, words: list[bytes]) -> set[int]:
        """Templates of which the words hold a prefix shingle."""
        out: set[int] = set()
        for word in self.second.intersection(words):
            k = -1
            while True:
                try:
                    k = words.index(word, k + 1)
                except ValueError:
                    break
                if k and (r := self.rank.get((words[k - 1], word))) in self.by_rank:
                    out.update(t for t, _ in self.by_rank[r])
        return out

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(first word, word after the last, template, containment) of the blocks that join: of blocks of a template
        that overlap, the first of the fullest, from its first shared word to its last."""
        if not (found := self.candidates(words)):
            return []
        wanted = set().union(*(self.of[t] for t in found))
        at = [(k, r) for k, s in enumerate(zip(words, words[1:])) if (r := self.rank.get(s)) in wanted]
        out = []
        for t in sorted(found):
            own, need = self.of[t], self.need[t]
            here = [(k, r) for k, r in at if r in own]
            held = sorted({r for _, r in here})
            # Length filter, and what is left behind the first shared shingle.
            if len(held) < need or 1 + min(len(own) - self.sets[t].index(held[0]) - 1, len(held) - 1) < need:
                continue
            out += self.fullest(here, t)
        return out

    def fullest(self, here: list[tuple[int, int]], t: int) -> list[tuple[int, int, int, float]]:
        """The joined blocks among a template's shingles in a text, by a sliding window."""
        out: list[tuple[int, int, int, float]] = []
        inside: Counter[int] = Counter()
        left, last = 0, -1
        for k, r in here:
            inside[r] += 1
            while k + 2 - here[left][0] > self.block[t]:
                gone = here[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            if len(inside) >= self.need[t]:
                block = (here[left][0], k + 2, t, len(inside) / len(self.of[t]))
                if out and here[left][0] < last:
                    if block[3] > out[-1][3]:
                        out[-1] = block
                else:
                    out.append(block)
                last = k + 2
        return out

    def labelled(self, joined: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Without what stands where a template of another label is held more fully."""
        joined, longest = sorted(joined), max((x[1] - x[0] for x in joined), default=0)
        starts = [x[0] for x in joined]
        near = lambda x: joined[bisect_left(starts, x[0] - longest) : bisect_left(starts, x[1])]
        return [x for x in joined if not any(y[3] > x[3] and self.labels[y[2]] != self.labels[x[2]] and y[1] > x[0] for y in near(x))]


def shingle_frequency(docs: DataFrame, templates=TEMPLATES) -> dict[tuple[bytes, bytes], int]:
    """How many times all documents hold each of the templates' shingles: as many rows as the templates have."""
    vocabulary = sorted({s for _, text in templates for s in shingles_of(words_of(text))})

    def make():
        ids, second = {s: i for i, s in enumerate(vocabulary)}, {s[1] for s in vocabulary}

        def f(batch):
            counts: Counter[int] = Counter()
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if not second.isdisjoint(words):
                    counts.update(ids[s] for s in zip(words, words[1:]) if s in ids)
            return {"shingle": list(counts), "n": list(counts.values())}

        return f

    found = map_slices(pick(docs, "text").where("text is not null"), make, "shingle long, n long")
    rows = found.groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["shingle"]]: r["n"] for r in rows}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Labels of every document, and where they come from.

    ``n_base``, ``first_word``, ``last_word``: places where a phrase's words stand one after the other.
    ``labels``: the phrases' and the joined templates', but for a template that stands where one of another label is
    held more fully. ``blocks``: each joined block and template as ``first word:template:containment``; of blocks of
    one template that overlap, the fullest. ``score``: 1 with a phrase, else the best containment of a joined
    template, else 0.

    Null and empty texts have no words and no labels. A null doc_id is kept; repeated rows give repeated rows;
    an empty table gives none. Very long texts are read whole. Other columns, also of clashing names, are not read.
    """
    templates = tuple(templates)
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates travel with each task")
    frequency = shingle_frequency(docs, templates)

    def make():
        index = Index(templates, threshold, frequency, block_words)
        split = [(words_of(p), label) for p, label in phrases.items()]

        def one(text):
            words = words_of(text)
            found = [(k, label) for phrase, label in split for k in places(words, phrase)]
            starts = [k for k, _ in found]
            base = sorted({label for _, label in found})
            joined = index.labelled(index.matches(words))
            labels = sorted({*base, *(index.labels[t] for *_, t, _ in joined)})
            return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), 1.0 if base else max((c for *_, c in joined), default=0.0), ",".join(f"{s}:{t}:{c:.4f}" for s, _, t, c in joined)

        def f(batch):
            rows = [one(t) for t in batch.column(1).to_pylist()]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
            return {"doc_id": batch.column(0)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return f

    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return map_slices(rows, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")
