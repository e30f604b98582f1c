"""Licence scan with a generalised suffix automaton.

The automaton holds every substring of the licence templates, over words.
A text streams through it word by word; the automaton's matching statistic
(longest suffix of the words read so far that some template contains) gives
the maximal matches. Matches of at least ``LEAST`` words are chained, per
template, into spans: the next match must start after the last one in the text
and in the template, at most ``GAP`` words on. A span is a finding if it
covers ``COVER`` of its template's words or more.

Beside the templates there are fixed phrases, counted at every place where
their words stand consecutively (they may overlap each other).

Words that no template holds reset the automaton to its root, so only runs of
template words are walked. The state is one automaton of the templates' size
per worker and one text at a time.

Defined cases: null and word-free texts have no words and no finding; texts
are read whole; ties in coverage are ordered by label; rows repeated are
scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, raw_texts, slices, table, worker_state

LEAST = 4
GAP = 12
COVER = 0.6

#: Fixed phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed wording of public licence notices (label, notice).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: Bytes of a word after lower-casing: digits, a-z and every non-ASCII byte.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Every other byte to a blank, A-Z to a-z: the same words by a plain split.
FOLD = bytes(b if WORD.fullmatch(bytes([b])) else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over integer tokens.

    ``ends[state]`` maps a template to the first end position, in it, of the
    state's substrings."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(k, at)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[s]]
            for k, at in self.ends[s].items():
                up[k] = min(up.get(k, at), at)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, token: int) -> int:
        q = self.next[p].get(token)
        if q is not None:  # the string is known from an earlier sequence
            return q if self.length[p] + 1 == self.length[q] else self._split(p, token, q)
        new = self._new(self.length[p] + 1, 0, {})
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._split(p, token, q)
        return new

    def statistics(self, tokens: Iterable[int]):
        """(state, matched length) after each token."""
        state = length = 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if t in self.next[state]:
                state = self.next[state][t]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = LEAST, gap: int = GAP, cover: float = COVER):
        self.least, self.gap, self.cover = least, gap, cover
        self.labels = [label for label, _ in templates]
        cut = [words_of(text.encode()) for _, text in templates]
        self.index = {w: k for k, w in enumerate(dict.fromkeys(w for t in cut for w in t))}
        self.sizes = [len(t) for t in cut]
        self.automaton = SuffixAutomaton([[self.index[w] for w in t] for t in cut])
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.lead = {}
        for p, label in self.phrases:
            self.lead.setdefault(p[0], []).append((p, label))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every phrase in the text, in text order."""
        out = []
        for first, candidates in self.lead.items():
            at = -1
            for _ in range(words.count(first)):
                at = words.index(first, at + 1)
                out += [(at, label) for p, label in candidates if words[at : at + len(p)] == p]
        return sorted(out)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """Maximal matches of ``least`` words or more: (end in the text,
        length, state)."""
        known = [k for k, w in enumerate(words) if w in self.index]
        out, at = [], 0
        while at < len(known):
            stop = at
            while stop + 1 < len(known) and known[stop + 1] == known[stop] + 1:
                stop += 1
            if stop - at + 1 >= self.least:
                first = known[at]
                run = [self.index[w] for w in words[first : known[stop] + 1]]
                before = (0, 0)
                for k, now in enumerate(self.automaton.statistics(run)):
                    if before[1] >= self.least and now[1] <= before[1]:
                        out.append((first + k - 1, before[1], before[0]))
                    before = now
                if before[1] >= self.least:
                    out.append((known[stop], before[1], before[0]))
            at = stop + 1
        return out

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, label, share of the template covered)."""
        chains: dict[int, list[list[int]]] = {}
        for end, length, state in self.matches(words):
            for k, t_end in self.automaton.ends[state].items():
                start, t_start = end - length + 1, t_end - length + 1
                open_ = chains.setdefault(k, [])
                if open_ and 0 < start - open_[-1][1] <= self.gap and t_start > open_[-1][2]:
                    open_[-1][1:] = [end, t_end, open_[-1][3] + length]
                else:
                    open_.append([start, end, t_end, length])
        found = [
            (a, b, self.labels[k], min(1.0, n / self.sizes[k])) for k, chain in chains.items() for a, b, _, n in chain if n >= self.cover * self.sizes[k]
        ]
        return sorted(found)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first:long,last:long,label:string,cover:double>>"
)
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))
_KINDS = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), _SPAN]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Words, phrase places, labels, template spans and a score of every row.

    ``score`` is 1 for a text with a phrase, else the best coverage found."""
    bounded_batches(docs.sparkSession)
    key = f"licenses:{hash((templates, tuple(phrases.items())))}"

    def run(frames):
        scanner = worker_state(key, lambda: Scanner(templates, phrases))
        for b in slices(frames):
            rows = []
            for raw in raw_texts(b.column(1)):
                words = words_of(raw)
                places = scanner.places(words)
                spans = scanner.spans(words)
                base = sorted({label for _, label in places})
                every = sorted({*base, *(s[2] for s in spans)})
                score = 1.0 if places else max((s[3] for s in spans), default=0.0)
                first, last = (places[0][0], places[-1][0]) if places else (None, None)
                rows.append((len(words), len(places), first, last, ",".join(base), ",".join(every), score, [dict(zip(("first", "last", "label", "cover"), s, strict=True)) for s in spans]))
            columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], ["doc_id", *_NAMES])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
