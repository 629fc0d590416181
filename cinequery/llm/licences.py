"""Licence notices, found by running texts through a suffix automaton of the templates' words.

The automaton of all templates gives, word by word, the longest run of words ending there that
stands in some template (matching statistics). Runs that no word prolongs and that are long enough
are placed in their templates and chained, in the order of text and template alike, with small gaps;
a chain that covers most of a template is a span of it and gives its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.llm.common import hashes, released, text_blocks, words

#: Phrases and their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Notices of common licences, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license. See the LICENSE file in the project root for full license information."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: Words of the shortest run that is placed, words left out at most between two runs of a chain, and the share of a template that makes a span.
MATCH, GAP, COVERED = 4, 12, 0.8
#: Words of all templates at most, as their automaton is sent to every worker.
MOST_WORDS = 1 << 20


def split(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """All suffixes of several sequences of word numbers: states with their longest length, the link to the longest suffix elsewhere, and moves by word."""

    longest: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    #: Where each state's own prefixes end: (sequence, words up to there).
    own: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, longest: int, link: int, moves: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.moves.append(moves)
        self.own.append([])
        return len(self.longest) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of ``at`` and ``word`` alone, parted from longer ones that so far share its state."""
        to = self.moves[at][word]
        if self.longest[to] == self.longest[at] + 1:
            return to
        part = self._state(self.longest[at] + 1, self.link[to], dict(self.moves[to]))
        self.link[to] = part
        while at >= 0 and self.moves[at].get(word) == to:
            self.moves[at][word] = part
            at = self.link[at]
        return part

    def _next(self, last: int, word: int) -> int:
        if word in self.moves[last]:
            return self._split(last, word)
        new, at = self._state(self.longest[last] + 1, 0, {}), last
        while at >= 0 and word not in self.moves[at]:
            self.moves[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def add(self, sequence: int, numbers: list[int]) -> int:
        """The state of a whole sequence, once it is added."""
        last = 0
        for end, word in enumerate(numbers, 1):
            last = self._next(last, word)
            self.own[last].append((sequence, end))
        return last

    def places(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """All ends of prefixes in an order where those that end with a state's words are together, and each state's part of them."""
        below: list[list[int]] = [[] for _ in self.link]
        for state, link in enumerate(self.link):
            if link >= 0:
                below[link].append(state)
        order, part, open_ = [], [(0, 0)] * len(self.link), [(0, False)]
        while open_:
            state, done = open_.pop()
            if done:
                part[state] = (part[state][0], len(order))
                continue
            part[state] = (len(order), 0)
            order += self.own[state]
            open_.append((state, True))
            open_ += [(s, False) for s in below[state]]
        return order, part


class Templates:
    """The automaton of templates and base phrases, with its words' hashes, and what a state tells."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE) -> None:
        self.base, texts = base, [split(t) for _, t in (*templates, *base)]
        if sum(map(len, texts)) > MOST_WORDS:
            raise ValueError(f"templates of over {MOST_WORDS} words")
        if not all(texts):
            raise ValueError("a template without words")
        self.labels, self.sizes = [label for label, _ in (*templates, *base)], [len(t) for t in texts]
        self.notices = len(templates)
        names = sorted({w for t in texts for w in t})
        number = {w: k for k, w in enumerate(names)}
        raw = [w.encode() for w in names]
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        h = hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends) if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.automaton = Automaton()
        whole = [self.automaton.add(k, [number[w] for w in t]) for k, t in enumerate(texts)]
        self.ends, self.part = self.automaton.places()
        # A phrase ends where the longest run does if its state is that run's, or one that links lead to.
        own: dict[int, list[int]] = {}
        for k in range(self.notices, len(texts)):
            own.setdefault(whole[k], []).append(k)
        a = self.automaton
        self.phrases: list[tuple[int, ...]] = [()] * len(a.link)
        for state in sorted(range(len(a.link)), key=a.longest.__getitem__):
            self.phrases[state] = (*(self.phrases[a.link[state]] if a.link[state] >= 0 else ()), *own.get(state, ()))
        self.least = min(self.sizes, default=1)

    def numbered(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes; -1 for those in no template."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def statistics(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run ending at each of some words that all stand in templates."""
        moves, link, longest = self.automaton.moves, self.automaton.link, self.automaton.longest
        state = length = 0
        for word in numbers:
            while word not in moves[state]:
                state = link[state]
                length = longest[state]
            state = moves[state][word]
            length += 1
            yield state, length

    def found(self, numbers: list[int], at: int, match: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of a stretch of template words that begins at word ``at``: base phrases (which, start), and long runs no word prolongs (start, past, state)."""
        phrases, long = [], []
        before, last = 0, 0
        for k, (state, length) in enumerate(self.statistics(numbers), at):
            for p in self.phrases[state]:
                if self.sizes[p] <= length:
                    phrases.append((p, k + 1 - self.sizes[p]))
            if last >= match and length <= last:
                long.append((k - last, k, before))
            before, last = state, length
        if last >= match:
            past = at + len(numbers)
            long.append((past - last, past, before))
        return phrases, long

    def chained(self, long: list[tuple[int, int, int]], gap: int, covered: float) -> tuple[list[tuple[str, int, int, int, int]], float]:
        """Spans (label, template, first, past, words covered) of chains that cover the share ``covered`` of a template, and the largest share of any."""
        placed: dict[int, list[tuple[int, int, int, int]]] = {}
        for first, past, state in long:
            for template, end in self.ends[slice(*self.part[state])]:
                if template < self.notices:
                    placed.setdefault(template, []).append((past, end, past - first, first))
        spans, best = [], 0.0
        for template, runs in placed.items():
            runs.sort()
            chains: list[tuple[int, int]] = []  # of each run: words its best chain covers, and the run that begins it
            for k, (past, end, size, first) in enumerate(runs):
                most = (size, k)
                for j in range(k - 1, -1, -1):
                    past_j, end_j, _, _ = runs[j]
                    if past_j < first - gap:
                        break
                    if past_j < past and end_j < end and end - size - end_j <= gap:
                        most = max(most, (chains[j][0] + min(size, past - past_j, end - end_j), chains[j][1]), key=lambda c: c[0])
                chains.append(most)
            longest: dict[int, tuple[int, int]] = {}
            for k, (words_, root) in enumerate(chains):
                longest[root] = max(longest.get(root, (0, 0)), (words_, -k))
            taken: list[tuple[int, int]] = []
            for (words_, k), root in sorted(((v, r) for r, v in longest.items()), key=lambda x: (-x[0][0], x[1])):
                share, first, past = words_ / self.sizes[template], runs[root][3], runs[-k][0]
                best = max(best, share)
                if share >= covered and all(past <= a or first >= b for a, b in taken):
                    taken.append((first, past))
                    spans.append((self.labels[template], template, first, past, words_))
        return spans, best


SPAN = "array<struct<label:string,template:int,first:long,past:long,covered:long>>"
SCHEMA = f"doc_id {{id}}, n_words long, phrases array<struct<label:string,first:long>>, spans {SPAN}, score double"


def _stretches(numbers: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``least`` template words or more within a row."""
    known = np.flatnonzero(numbers >= 0)
    if not len(known):
        return known, known
    new = np.ones(len(known), bool)
    new[1:] = (np.diff(known) > 1) | (np.diff(row[known]) > 0)
    first = np.flatnonzero(new)
    starts, ends = known[first], known[np.append(first[1:], len(known)) - 1] + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def scan(batches: Iterator[pa.RecordBatch], templates: Templates, match: int, gap: int, covered: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 4 << 20):
            row, h, _ = words(data, offsets)
            numbers = templates.numbered(h)
            first = np.searchsorted(row, np.arange(len(rows) + 1))
            phrases: list[list] = [[] for _ in range(len(rows))]
            long: list[list] = [[] for _ in range(len(rows))]
            for a, b in zip(*(x.tolist() for x in _stretches(numbers, row, min(templates.least, match))), strict=True):
                r = int(row[a])
                p, m = templates.found(numbers[a:b].tolist(), a - int(first[r]), match)
                phrases[r] += [(templates.labels[k], at) for k, at in p]
                long[r] += m
            spans, scores = [], []
            for p, m in zip(phrases, long, strict=True):
                s, score = templates.chained(m, gap, covered) if m else ([], 0.0)
                spans.append([dict(zip(("label", "template", "first", "past", "covered"), x, strict=True)) for x in sorted(s, key=lambda x: x[2:])])
                scores.append(1.0 if p else score)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array([[{"label": x, "first": at} for x, at in p] for p in phrases], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("past", pa.int64()), ("covered", pa.int64())]))),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "n_words", "phrases", "spans", "score"],
            )


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, match: int = MATCH, gap: int = GAP, covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, phrases (label, first word of each place of a base phrase), spans (label, template, first and past word, words covered), score, of each row.

    score is the largest share of a template that a chain covers, and 1 where a base phrase stands.
    A text is streamed once; null and empty texts have no words. Rows, ids null or repeated, and
    further columns have no influence on each other: there is no shuffle. An empty table gives an
    empty result. Templates are bounded by MOST_WORDS words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, base))
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: released(scan(batches, shared.value, match, gap, covered)), schema)


def report(docs: DataFrame, **how) -> DataFrame:
    """The digest of ``spans``: words, places of base phrases with the first and last word of theirs, their labels, all labels, score, and the spans."""
    names = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda s: s["label"]) for x in lists)))), ",")
    starts = F.transform("phrases", lambda p: p["first"])
    return spans(docs, **how).select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names("phrases").alias("base_labels"), names("phrases", "spans").alias("labels"), "score", "spans"
    )
