"""Operator 5: licence scans with a generalised suffix automaton.

The automaton holds the words of all licence templates; its size follows the templates, which are a parameter. A text is streamed
through it: at each word the state and the length of the longest template run that ends there are the matching statistics. Runs
of ``least`` words or more that cannot be extended are chained per template, in the order of text and template, into covered
spans. Only stretches that share a run of ``least`` words with a template (found by hash) enter the automaton, which skips no
match of that length. Every document is handled in its own row, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.token_arrays import ALPHANUMERIC, Words, find_words, windows, word_slices

#: Phrases that always give their label (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices of common licences (fixed values); a label may have several.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
)

#: Shortest match that is chained, widest gap inside a chain (words of text or template), covered share that gives a label.
LEAST, GAP, COVERED = 3, 6, 0.8


def _split(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over lists of word numbers; ``places[s]`` maps a template to an end of state s's runs in it."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split_state(self, p: int, word: int, q: int) -> int:
        """``q`` where it is the state for p's longest run and ``word``, else a copy of it that is."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split_state(last, word, self.next[last][word])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split_state(p, word, self.next[p][word])
        return new

    @classmethod
    def of(cls, lists: list[list[int]]) -> SuffixAutomaton:
        self = cls()
        for words in lists:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for t, words in enumerate(lists):
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                s = state
                while s > 0 and t not in self.places[s]:
                    self.places[s][t] = i + 1
                    s = self.link[s]
        return self

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """``(state, length of the longest run of a template that ends here)`` for each word; -1 is a word of no template."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                state = length = 0
            yield state, length

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """``(template, text start, template start, length)`` of the runs that cannot be extended to the right."""
        found, seen = [], list(self.statistics(words))
        for i, (state, length) in enumerate(seen):
            if length >= least and (i + 1 == len(seen) or seen[i + 1][1] <= length):
                found += [(t, i + 1 - length, end - length, length) for t, end in self.places[state].items()]
        return found


def chained(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """``(text start, text end, covered template words)`` of chains of ``(text start, template start, length)``.

    A match extends the best chain that ends before it in text and template, with at most ``gap`` words between; of equally
    good ones the last. Only matches that end within ``gap`` words before it are looked at, so a text of many matches costs a
    multiple of its length. Chains are taken best first, without using a match twice.
    """
    matches = sorted(set(matches))
    best, back = [], []
    ends: dict[int, list[int]] = {}  # matches by the text position at which they end
    for i, (x, y, n) in enumerate(matches):
        top, via = 0, -1
        for j in (j for end in range(x - gap, x + 1) for j in ends.get(end, ())):
            if 0 <= y - matches[j][1] - matches[j][2] <= gap and (best[j], j) > (top, via):
                top, via = best[j], j
        best.append(top + n)
        back.append(via)
        ends.setdefault(x + n, []).append(i)
    out, used = [], set()
    for i in sorted(range(len(matches)), key=lambda k: (-best[k], k)):
        if i in used:
            continue
        covered, k, first = 0, i, matches[i][0]
        while k != -1 and k not in used:
            used.add(k)
            covered, first = covered + matches[k][2], matches[k][0]
            k = back[k]
        out.append((first, matches[i][0] + matches[i][2], covered))
    return out


class Scanner:
    """Phrases and templates, compiled; small and sent to the tasks as it is."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least: int = LEAST, gap: int = GAP, covered: float = COVERED):
        self.least, self.gap, self.covered, self.labels = least, gap, covered, [label for label, _ in templates]
        self.lists = [_split(text) for _, text in templates]
        vocabulary = sorted({w for words in self.lists for w in words} | {w for p, _ in phrases for w in _split(p)})
        known = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = SuffixAutomaton.of([[known[w] for w in words] for words in self.lists])
        self.phrases = [([known[w] for w in _split(p)], label) for p, label in phrases]
        hashes = _hashes_of(vocabulary)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order.astype(np.int64)
        runs = [windows(_words_of(words), least, False)[0] for words in self.lists if len(words) >= least]
        self.runs = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)

    def numbers(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, words.hash), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words.hash, self.number[at], -1)

    def scan(self, words: Words) -> dict[int, dict]:
        """What was found, by the number of the text; texts without a find are left out."""
        ids, out = self.numbers(words), {}

        def of(d: int) -> dict:
            return out.setdefault(d, {"n_base": 0, "starts": [], "base": set(), "spans": []})

        for phrase, label in self.phrases:
            n = len(phrase)
            if len(ids) < n:
                continue
            last = len(ids) - n + 1
            hit = words.doc[:last] == words.doc[n - 1 :]
            for j, w in enumerate(phrase):
                hit = hit & (ids[j : last + j] == w)
            for i in np.flatnonzero(hit).tolist():
                found = of(int(words.doc[i]))
                found["n_base"] += 1
                found["starts"].append(i - int(words.first[words.doc[i]]))
                found["base"].add(label)
        hashes, texts, at = windows(words, self.least, False)
        place = np.minimum(np.searchsorted(self.runs, hashes), max(0, len(self.runs) - 1))
        hits = at[self.runs[place] == hashes] if len(self.runs) else at[:0]
        begin = 0
        while begin < len(hits):  # one stretch for hits close together in one text
            end = begin
            while end + 1 < len(hits) and words.doc[hits[end + 1]] == words.doc[hits[begin]] and hits[end + 1] - hits[end] <= self.least + self.gap:
                end += 1
            d, low, high = int(words.doc[hits[begin]]), int(hits[begin]), int(hits[end]) + self.least
            by_template: dict[int, list] = {}
            for t, x, y, n in self.automaton.matches(ids[low:high].tolist(), self.least):
                by_template.setdefault(t, []).append((x, y, n))
            base = low - int(words.first[d])
            for t, matches in by_template.items():
                for x, to, covered in chained(matches, self.gap):
                    of(d)["spans"].append((self.labels[t], base + x, base + to, covered / len(self.lists[t])))
            begin = end + 1
        return out


def _words_of(words: list[str]) -> Words:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return find_words(data, np.array([0, len(data)]), ALPHANUMERIC, True)


def _hashes_of(words: list[str]) -> np.ndarray:
    return _words_of(words).hash


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:int,stop:int,covered:double>>"
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("covered", pa.float64())]))


def license_scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Base places and labels, the method's labels and spans, and ``score``, the largest share of a template that is covered.

    One row per row of ``docs``; words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A null or
    empty text has no words, no labels and score 0. Spans list chains that cover at least half of a template. Other columns
    are not read.
    """
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, words in word_slices(b.column("text"), ALPHANUMERIC):
                n, found = words.texts, scanner.scan(words)
                cells: dict[str, list] = {"n_base": [0] * n, "first": [None] * n, "last": [None] * n, "base": [""] * n, "labels": [""] * n, "score": [0.0] * n, "spans": [[]] * n}
                for d, x in found.items():
                    own = {label for label, _, _, c in x["spans"] if c >= scanner.covered}
                    cells["n_base"][d] = x["n_base"]
                    if x["starts"]:
                        cells["first"][d], cells["last"][d] = min(x["starts"]), max(x["starts"])
                    cells["base"][d], cells["labels"][d] = ",".join(sorted(x["base"])), ",".join(sorted(x["base"] | own))
                    cells["score"][d] = min(1.0, max([0.0, *(s[3] for s in x["spans"])]))
                    cells["spans"][d] = [dict(zip(("label", "start", "stop", "covered"), s)) for s in sorted(x["spans"], key=lambda s: (s[1], s[0])) if s[3] >= 0.5]
                yield pa.record_batch(
                    [b.column("doc_id").slice(at, n), pa.array(words.counts.astype(np.int64)), pa.array(cells["n_base"], pa.int64()), pa.array(cells["first"], pa.int64()), pa.array(cells["last"], pa.int64()), pa.array(cells["base"], pa.string()), pa.array(cells["labels"], pa.string()), pa.array(cells["score"], pa.float64()), pa.array(cells["spans"], _SPANS)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
