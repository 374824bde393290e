"""Scan for licence notices and texts.

Templates are cut into words; of each window of WINDOW successive GRAM-word
hashes the least is kept (winnowing), and an inverted index leads from these
fingerprints to templates and places.  The index is as large as the templates,
which the caller gives and whose size is checked, so each task has it.  A
document whose word hashes hit the index is a candidate; around the hits
template and document are aligned in a band, which tells the words matched, the
coverage of the template and the span in the document.

Words in [brackets] tell a template from its neighbours: all of them must be in
the document, next to each other as in the template, however much of the rest is
there ("GNU [Lesser] General" is no GPL).  Their first two words are always a
fingerprint, so an edited notice is found whatever else of it was changed: each
place that holds them is aligned, through them.  Templates without brackets are
found by winnowed fingerprints, and where an edit left none, at places which hold
as many of their words as MIN_COVERAGE needs, as close together as the band
allows, aligned at every diagonal of these words.

Defined results: a null or empty text has no match; words are compared in lower
case, with `licence` as `license`, so lay-out and punctuation don't matter; a
notice that occurs several times is reported each time; a shorter match inside a
longer one of another template is left out, and of equal spans the template with
more words matched, then better covered, then first by name, is reported; texts
over BLOCK bytes are scanned in blocks that overlap by CONTEXT, which a span must
not exceed; equal rows get equal rows; an empty table gives an empty table;
columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents
from tessera.llm.hashing import shingle_hashes, word_spans

GRAM = 3
WINDOW = 3
MIN_COVERAGE = 0.8
#: Template words that the index takes at most; more are refused, as each task holds it.
INDEX_LIMIT = 4_000_000

#: Bytes of a text that are scanned together, and what each such block sees of its neighbours.
BLOCK = 8 << 20
CONTEXT = 1 << 20

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU {}] as published by the Free Software Foundation, [either version {} of the License], or (at your option) any later version."
_COMMONS = "This work is licensed under a [Creative Commons Attribution{} 4.0] International License."
_KINDS = {"BY": "", "BY-SA": "-ShareAlike", "BY-ND": "-NoDerivatives", "BY-NC": "-NonCommercial", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software [without restriction], including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
#: Notices by which works declare a licence, and the opening of the licences themselves; brackets hold what tells them apart.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or [without fee] is hereby granted.",
    "AGPL-3.0": "This work is licensed under the [GNU Affero General Public License], [version 3].",
    "AGPL-3.0 header": _GNU.format("Affero General Public License", 3),
    "Apache-1.1": "Licensed under the [Apache Software License], [Version 1.1].",
    "Apache-1.1 text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "3. The end-user documentation included with the redistribution, if any, must include the following acknowledgment: \"This product includes software developed by the [Apache Software Foundation] (http://www.apache.org/).\"",
    "Apache-2.0": "Licensed under the [Apache License], Version [2.0].",
    "Apache-2.0 header": "Licensed under the [Apache License], Version [2.0] (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and [binary forms], with or without modification, are permitted provided that the following conditions are met:",
    **{f"CC-{kind}-4.0": f"Licensed under [CC {kind} 4.0]." for kind in _KINDS},
    **{f"CC-{kind}-4.0 notice": _COMMONS.format(long) for kind, long in _KINDS.items()},
    "CC0-1.0": "To the extent possible under law, the author has [waived all copyright] and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the [GNU General Public License], [version 2].",
    "GPL-2.0 header": _GNU.format("General Public License", 2),
    "GPL-3.0": "This work is licensed under the [GNU General Public License], [version 3].",
    "GPL-3.0 header": _GNU.format("General Public License", 3),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or [without fee] is hereby granted, provided that the above copyright notice "
    "and [this permission notice appear] in all copies.",
    "LGPL-2.1": "This work is licensed under the [GNU Lesser General Public License], [version 2.1].",
    "LGPL-2.1 header": _GNU.format("Lesser General Public License", 2.1),
    "LGPL-3.0": "This work is licensed under the [GNU Lesser General Public License], [version 3].",
    "LGPL-3.0 header": _GNU.format("Lesser General Public License", 3),
    "MIT": "Released under the [MIT License].",
    "MIT text": f"{_GRANT}, [subject to] the following conditions:",
    "MIT-0 text": f"{_GRANT}.",
    "MIT warranty": "The above copyright notice and [this permission notice] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
    "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the [Mozilla Public License], v. [2.0].",
    "Unlicense": "This is free and [unencumbered software released into the public domain]. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

MATCHES = "doc_id long, license string, coverage double, matched_words int, template_words int, start_char long, end_char long, span string"


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, the last of equal ones."""
    if len(hashes) <= window:
        return np.array([int(np.argmin(hashes))]) if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


class Vocabulary:
    """Which templates have which words: tells the places of a document that hold enough of a template's words."""

    def __init__(self, templates: dict[str, np.ndarray]):
        self.names = [n for n in sorted(templates) if len(templates[n])]
        self.size = np.array([len(templates[n]) for n in self.names])
        self.need = np.array([least_words(int(n)) for n in self.size], np.int64)
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *templates.values()]))
        self.own = [np.searchsorted(self.words, np.unique(templates[n])) for n in self.names]
        word = np.concatenate([np.zeros(0, np.int64), *self.own])
        order = np.argsort(word, kind="stable")
        self.template = np.repeat(np.arange(len(self.own)), [len(o) for o in self.own])[order]
        self.bounds = np.searchsorted(word[order], np.arange(len(self.words) + 1))
        self.origins = {n: _origins(templates[n].tolist()) for n in self.names}

    def places(self, words: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
        """(template, words needed, places that hold one of its words) for templates of which the document has enough words."""
        if not len(self.words) or not len(words):
            return
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == words)
        if len(hit) < self.need.min():
            return
        ids = at[hit]
        times = np.bincount(ids, minlength=len(self.words))
        seen = np.flatnonzero(times)
        long = self.bounds[seen + 1] - self.bounds[seen]
        rows = np.repeat(self.bounds[seen] - np.append(0, np.cumsum(long)[:-1]), long) + np.arange(long.sum())
        total = np.bincount(self.template[rows], np.repeat(times[seen], long), len(self.names))
        mine = np.zeros(len(self.words), bool)
        for t in np.flatnonzero(total >= self.need).tolist():
            mine[self.own[t]] = True
            yield self.names[t], int(self.need[t]), hit[mine[ids]]
            mine[self.own[t]] = False


def _origins(template: list[int]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, word in enumerate(template):
        found.setdefault(word, []).append(i)
    return found


def least_words(size: int) -> int:
    """The words of a template that a match has at least."""
    return next(n for n in range(size + 1) if n and n >= MIN_COVERAGE * size)


def band_of(size: int) -> int:
    return max(3, size // 5)


def dense(places: np.ndarray, need: int, span: int) -> list[np.ndarray]:
    """Groups of places of which each belongs to `need` places within span; groups are a span apart or do not overlap."""
    if len(places) < need:
        return []
    close = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < span)
    edge = np.zeros(len(places) + 1, np.int64)
    np.add.at(edge, close, 1)
    np.add.at(edge, close + need, -1)
    inside = np.zeros(len(places) + 2, np.int8)
    inside[1:-1] = np.cumsum(edge[:-1]) > 0
    turn = np.diff(inside)
    runs = zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)
    return [places[a:b] for a, b in runs if b - a >= need]


def starts(template: list[int], origins: dict[int, list[int]], words: np.ndarray, group: np.ndarray, need: int, span: int) -> Iterator[int]:
    """The places of a group from which on span words have `need` words of the template in common, in order."""
    place, word = group.tolist(), words[group].tolist()
    masks = {w: sum(1 << i for i in own) for w, own in origins.items()}
    full, held, common, stop = (1 << len(template)) - 1, dict.fromkeys(origins, 0), 0, 0
    for first, begin in enumerate(place):
        while stop < len(place) and place[stop] < begin + span:
            held[word[stop]] += 1
            common += held[word[stop]] <= len(origins[word[stop]])
            stop += 1
        if common >= need:
            left = full
            for w in word[first:stop]:
                met = left & masks[w]
                left = ((left + met) | (left - met)) & full
            if len(template) - left.bit_count() >= need:
                yield begin
        common -= held[word[first]] <= len(origins[word[first]])
        held[word[first]] -= 1


_BRACKETS = re.compile(rb"\[([^\]]*)\]")
_SPELLINGS = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed"}


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of words, with one spelling of licence."""
    words, begin, end = word_spans(raw)
    for other, usual in _SPELLINGS.items():
        words[words == word_spans(other)[0][0]] = word_spans(usual)[0][0]
    return words, begin, end


class Index:
    """Templates by their fingerprints: words, marks (from, to) by place, and which of them are looked for by vocabulary too."""

    def __init__(self, templates: dict[str, str]):
        self.words: dict[str, list[int]] = {}
        self.marks: dict[str, list[tuple[int, int]]] = {}
        prints: dict[int, list[tuple[str, int]]] = {}
        pairs: dict[int, list[tuple[str, int]]] = {}
        held = {}
        for name in sorted(templates):
            raw = templates[name].encode()
            words, begin, _ = words_of(raw)
            held[name], self.words[name] = words, words.tolist()
            spans = [(int(np.searchsorted(begin, m.start())), int(np.searchsorted(begin, m.end()))) for m in _BRACKETS.finditer(raw)]
            if any(b - a < 2 for a, b in spans):
                raise ValueError(f"{name}: brackets hold two words at least")
            self.marks[name] = spans
            if spans:
                own = shingle_hashes(words[slice(*spans[0])], 2)
                pairs.setdefault(int(own[0]), []).append((name, spans[0][0]))
                continue
            grams = shingle_hashes(words, GRAM)
            for at in winnow(grams, WINDOW).tolist():
                prints.setdefault(int(grams[at]), []).append((name, at))
        if sum(map(len, held.values())) > INDEX_LIMIT:
            raise ValueError(f"the templates have more than {INDEX_LIMIT} words")
        self.prints, self.pairs = _sorted(prints), _sorted(pairs)
        self.vocabulary = Vocabulary({n: w for n, w in held.items() if not self.marks[n]})


def _sorted(postings: dict[int, list[tuple[str, int]]]) -> tuple[np.ndarray, list[list[tuple[str, int]]]]:
    order = sorted(postings)
    return np.array(order, np.uint64), [postings[k] for k in order]


def hits_of(words: np.ndarray, size: int, postings: tuple) -> Iterator[tuple[str, int, int]]:
    """(template, place in it, place in the document) where a run of size words is a fingerprint."""
    keys, lists = postings
    if len(words) < size or not len(keys):
        return
    grams = shingle_hashes(words, size)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    for place in np.flatnonzero(keys[at] == grams).tolist():
        for name, origin in lists[at[place]]:
            yield name, origin, place


def align_marked(template: list[int], marks: list[tuple[int, int]], words: list[int], diagonal: int, band: int) -> list[tuple[int, int]]:
    """Matched places (template, words) of the best alignment within the band that passes through all marks, each met as a whole, the first of them on the diagonal; empty if there is none."""
    whole = dict(marks)
    inside = {i for a, b in marks for i in range(a + 1, b)}
    first, width, none = marks[0][0], 2 * band + 1, -1 << 20
    score = [[none] * (width + 2) for _ in range(len(template) + 1)]  # column c: word = i + diagonal + c - band - 1
    score[len(template)] = [0] * (width + 2)
    for i in range(len(template) - 1, -1, -1):
        row, below = score[i], score[i + 1]
        for c in range(width, 0, -1):
            j = i + diagonal + c - 1 - band
            best = row[c + 1] if c < width else none
            if i in whole:
                to = whole[i]
                if 0 <= j and words[j : j + to - i] == template[i:to] and (i != first or j == i + diagonal):
                    best = max(best, score[to][c] + to - i)
            elif i not in inside:
                best = max(best, below[c - 1] if c > 1 else none)
                if 0 <= j < len(words) and template[i] == words[j]:
                    best = max(best, below[c] + 1)
            row[c] = best
    found, i = [], 0
    c = max(range(1, width + 1), key=lambda c: score[0][c])
    if score[0][c] <= 0:
        return []
    while i < len(template):
        j = i + diagonal + c - 1 - band
        to = whole.get(i, i + 1)
        if 0 <= j and words[j : j + to - i] == template[i:to] and (i != first or j == i + diagonal) and score[i][c] == score[to][c] + to - i:
            found += [(i + k, j + k) for k in range(to - i)]
            i = to
        elif c < width and score[i][c] == score[i][c + 1]:
            c += 1
        else:
            i, c = i + 1, c - 1
    return found


def align(template: list[int], words: list[int], diagonal: int, band: int) -> list[tuple[int, int]]:
    """Matched places (template, words) of the best alignment with |word - template - diagonal| <= band."""
    width = 2 * band + 1
    score = [[0] * (width + 2) for _ in range(len(template) + 1)]  # column c: word = i + diagonal + c - band - 1
    for i in range(len(template) - 1, -1, -1):
        row, below = score[i], score[i + 1]
        for c in range(width, 0, -1):
            j = i + diagonal + c - 1 - band
            # Leave out a template word (down is one column to the left), or a document word.
            best = max(below[c - 1] if c > 1 else 0, row[c + 1] if c < width else 0)
            if 0 <= j < len(words) and template[i] == words[j]:
                best = max(best, below[c] + 1)
            row[c] = best
    found, i = [], 0
    c = max(range(1, width + 1), key=lambda c: score[0][c])
    while i < len(template) and 1 <= c <= width:
        j = i + diagonal + c - 1 - band
        if 0 <= j < len(words) and template[i] == words[j] and score[i][c] == score[i + 1][c] + 1:
            found.append((i, j))
            i += 1
        elif c < width and score[i][c] == score[i][c + 1]:
            c += 1
        else:
            i, c = i + 1, c - 1
    return found


_GAP = re.compile(rb"[^0-9A-Za-z_\x80-\xff]")


def _blocks(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(from, own from, own to, to): each block owns the matches that start in its own part, and sees CONTEXT around it."""

    def gap(at: int) -> int:
        met = _GAP.search(raw, at) if 0 < at < len(raw) else None
        return met.start() if met else (0 if at <= 0 else len(raw))

    first = 0
    while first < len(raw):
        last = gap(first + BLOCK)
        yield gap(first - CONTEXT), first, last, gap(last + CONTEXT)
        first = last


def scan(raw: bytes, index: Index) -> list[tuple[str, float, int, int, int, int]]:
    """(template, coverage, words matched, words of the template, from byte, to byte)."""
    found = set()
    for low, first, last, high in _blocks(raw):
        found |= {(*m[:4], m[4] + low, m[5] + low) for m in _found(raw[low:high], index) if first <= m[4] + low < last}
    # A span that starts no earlier and ends no later than another is left out; of equal ones the better stays.
    taken, furthest = [], -1
    for match in sorted(found, key=lambda m: (m[4], -m[5], -m[2], -m[1], m[0])):
        if match[5] > furthest:
            taken.append(match)
            furthest = match[5]
    return taken


def _found(raw: bytes, index: Index) -> list[tuple[str, float, int, int, int, int]]:
    words, begin, end = words_of(raw)
    found = []

    def take(name: str, pairs: list[tuple[int, int]]) -> None:
        first, last, total = pairs[0][1], pairs[-1][1], len(index.words[name])
        found.append((name, len(pairs) / total, len(pairs), total, int(begin[first]), int(end[last])))

    marked: dict[str, list[list[tuple[int, int]]]] = {}
    for name, origin, place in hits_of(words, 2, index.pairs):
        template, mark = index.words[name], index.marks[name][0]
        if words[place : place + mark[1] - mark[0]].tolist() != template[slice(*mark)]:
            continue
        band = band_of(len(template))
        low = max(0, place - origin - 2 * band)
        part = words[low : place + len(template) - origin + 2 * band].tolist()
        pairs = align_marked(template, index.marks[name], part, place - origin - low, band)
        if len(pairs) >= MIN_COVERAGE * len(template):
            marked.setdefault(name, []).append([(i, low + j) for i, j in pairs])
    for name, own in marked.items():
        # The places of one template that share words: the better covered stay, then the first.
        used: set[int] = set()
        for pairs in sorted(own, key=lambda p: (-len(p), p[-1][1] - p[0][1], p[0][1])):
            if used.isdisjoint(range(pairs[0][1], pairs[-1][1] + 1)):
                used.update(range(pairs[0][1], pairs[-1][1] + 1))
                take(name, pairs)
    hits: dict[str, list[tuple[int, int]]] = {}
    for name, origin, place in hits_of(words, GRAM, index.prints):
        hits.setdefault(name, []).append((place - origin, place))
    covered: dict[str, list[tuple[int, int]]] = {}
    for name, own in hits.items():
        template = index.words[name]
        band = band_of(len(template))
        own.sort()
        while own:
            # Hits on diagonals close to each other belong to one occurrence.
            first = own[0][0]
            near = [h for h in own if h[0] - first <= band]
            own = own[len(near) :]
            low = max(0, first - band)
            part = words[low : first + 2 * band + len(template)].tolist()
            pairs = align(template, part, near[len(near) // 2][0] - low, band)
            if pairs and len(pairs) >= MIN_COVERAGE * len(template):
                take(name, [(i, low + j) for i, j in pairs])
                covered.setdefault(name, []).append((low + pairs[0][1], low + pairs[-1][1]))
    for name, need, places in index.vocabulary.places(words):
        template, origins = index.words[name], index.vocabulary.origins[name]
        band = band_of(len(template))
        span = len(template) + 2 * band
        parts, after = [], -1
        for first, last in sorted(covered.get(name, ())):
            parts.append(places[(places > after) & (places < first)])
            after = max(after, last)
        groups = [g for part in [*parts, places[places > after]] for g in dense(part, need, span)]
        while groups:
            group = groups.pop()
            for start in starts(template, origins, words, group, need, span):
                low, high = start, int(group[group < start + 2 * span][-1]) + 1
                part, best = words[low:high].tolist(), []
                for diagonal in sorted({j - i for j, word in enumerate(part) for i in origins.get(word, ())}):
                    pairs = align(template, part, diagonal, band)
                    if len(pairs) > len(best):
                        best = pairs
                if len(best) >= need:
                    best = [(i, low + j) for i, j in best]
                    take(name, best)
                    groups += [g for rest in (group[(group >= start) & (group < best[0][1])], group[group > best[-1][1]]) for g in dense(rest, need, span)]
                    break
    return found


def _scanner(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, coverage, matched, total, a, b in scan(raw, index) if raw else ():
                    start = len(raw[:a].decode("utf-8", "replace"))
                    span = raw[a:b].decode("utf-8", "replace")
                    rows.append({"doc_id": doc_id, "license": name, "coverage": coverage, "matched_words": matched, "template_words": total, "start_char": start, "end_char": start + len(span), "span": span})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("template_words", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("span", pa.string())])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match."""
    index = Index(TEMPLATES if templates is None else templates)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(_scanner(index), MATCHES)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
