"""Licence notices: edited ones, near misses, prose and long texts, against alignment at every place."""

import functools
import random
import re

import pytest

from tessera.llm import license_scan as ls
from tests.llm.test_operators import prose


@pytest.fixture(scope="module")
def index():
    return ls.Index(ls.TEMPLATES)


def names(text, index):
    return [m[0] for m in ls.scan(text.encode(), index)]


def split(template):
    """Words of a template, and which of them tell it apart."""
    words, marks = [], []
    for k, part in enumerate(re.split(r"[\[\]]", template)):
        own = re.findall(r"\w+", part)
        marks += [k % 2 == 1] * len(own)
        words += own
    return words, marks


@pytest.mark.parametrize(
    "text,want",
    [
        ("It was released under the same license", []),
        ("Released under the Apache License.", []),
        ("Released under the BSD License.", []),
        ("Released under the MIT-style license", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0 notice"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
        ("released under an MIT license and again released under the MIT licence. Released under the MIT License", ["MIT"] * 3),
        ("MIT MIT License. Released under the MIT License", ["MIT"]),
        (re.sub(r"[\[\]]", "", ls.TEMPLATES["MIT-0 text"]), ["MIT-0 text"]),
        (re.sub(r"[\[\]]", "", ls.TEMPLATES["MIT text"]), ["MIT text"]),
        ("He was licensed to drive, version 3 of the story said; the public license office was closed.", []),
    ],
)
def test_near_misses(index, text, want):
    assert names(f"Some words before. {text} And some after.", index) == want


def test_edited_notices(index):
    """Each template with any other word changed, left out or put in, or as many changed as the coverage allows; no word that tells it apart may be."""
    rng = random.Random(13)
    for name, text in ls.TEMPLATES.items():
        words, marks = split(text)
        spare = int(len(words) * (1 - ls.MIN_COVERAGE) + 1e-9)
        free = [k for k, m in enumerate(marks) if not m]
        edited = [[*words[:k], *new, *words[k + 1 :]] for k in free[: 30 * (spare > 0)] for new in (["qqq"], [])]
        edited += [[*words[:k], "qqq", *words[k:]] for k in free[:30]]
        edited += [["qqq" if k in off else w for k, w in enumerate(words)] for _ in range(5) for off in [set(rng.sample(free, min(spare, len(free))))]]
        for own in edited:
            raw = f"{prose(rng, 30)} {' '.join(own)} {prose(rng, 30)}".encode()
            assert any(m[0] == name or m[5] - m[4] > len(" ".join(own)) for m in ls.scan(raw, index)), (name, own)
        for k in (k for k, m in enumerate(marks) if m):
            for new in (["qqq"], [], ["qqq", words[k]] if k and marks[k - 1] else ["qqq"]):
                own = " ".join([*words[:k], *new, *words[k + 1 :]])
                # Two marks beside each other may have a word between them.
                if new[-1:] == [words[k]] and name in names(own, index):
                    assert re.search(r"\][^\w\[]*\[", text)
                else:
                    assert name not in names(own, index), (name, own)


def test_templates_without_marks():
    """They are found whichever words are changed."""
    plain = {n: re.sub(r"[\[\]]", "", ls.TEMPLATES[n]) for n in ("Apache-2.0", "Apache-2.0 header", "BSD", "CC-BY-NC-4.0", "CC0-1.0", "GPL-3.0", "GPL-3.0 header", "ISC", "MIT", "MIT text", "MPL-2.0", "Unlicense")}
    index, rng = ls.Index(plain), random.Random(14)
    for name, text in plain.items():
        words = re.findall(r"\w+", text)
        spare = int(len(words) * (1 - ls.MIN_COVERAGE) + 1e-9)
        edited = [[*words[:k], *new, *words[k + gone :]] for k in range(len(words)) for new, gone in ((["qqq"], 1), ([], 1), (["qqq"], 0))]
        edited += [["qqq" if k in off else w for k, w in enumerate(words)] for _ in range(5) for off in [set(rng.sample(range(len(words)), spare))]]
        edited += [[w for k, w in enumerate(words) for w in ([w, "qqq"] if k % 3 == 1 and len(words) < 12 else [w])]]
        for own in edited:
            raw = f"{prose(rng, 30)} {' '.join(own)} {prose(rng, 30)}".encode()
            assert any(m[0] == name or m[5] - m[4] > len(" ".join(own)) for m in ls.scan(raw, index)), (name, own)


def best_anywhere(template, marks, words, band):
    """The most words matched with the first mark at each place of the words, by plain recursion."""
    first = marks[0][0]
    out = {}
    for at in range(len(words)):
        if words[at : at + marks[0][1] - first] != template[first : marks[0][1]]:
            continue
        diagonal = at - first

        @functools.cache
        def most(i, j, diagonal=diagonal, at=at):
            if i == len(template):
                return 0
            if abs(j - i - diagonal) > band or j > len(words) + band:
                return -(1 << 20)
            ways = [most(i, j + 1)]
            mark = next((m for m in marks if m[0] <= i < m[1]), None)
            if mark is None:
                ways.append(most(i + 1, j))
                if 0 <= j < len(words) and template[i] == words[j]:
                    ways.append(1 + most(i + 1, j + 1))
            elif mark[0] == i and 0 <= j and words[j : j + mark[1] - i] == template[i : mark[1]] and (i != first or j == at):
                ways.append(mark[1] - i + most(mark[1], j + mark[1] - i))
            return max(ways)

        found = max(most(0, diagonal + c) for c in range(-band, band + 1))
        if found >= ls.MIN_COVERAGE * len(template):
            out[at] = found
    return out


def test_against_alignment_everywhere(index):
    """The words matched at each place of a first mark, over texts of whole, cut, shuffled and edited notices."""
    rng, short = random.Random(15), [n for n, t in ls.TEMPLATES.items() if len(t) < 220]
    for _ in range(25):
        words = []
        for _ in range(6):
            own = split(ls.TEMPLATES[rng.choice(short)])[0]
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = [rng.choice(["qqq", *own])]
            words += own[rng.randrange(2) :] + prose(rng, rng.randrange(4)).split()
        raw = " ".join(words).encode()
        hashes = ls.words_of(raw)[0].tolist()
        for name in short:
            template, marks = index.words[name], index.marks[name]
            band = ls.band_of(len(template))
            want = best_anywhere(template, marks, hashes, band)
            got = {}
            for n, origin, place in ls.hits_of(ls.words_of(raw)[0], 2, index.pairs):
                if n == name:
                    low = max(0, place - origin - 2 * band)
                    pairs = ls.align_marked(template, marks, hashes[low : place + len(template) + 2 * band], place - origin - low, band)
                    assert all(template[i] == hashes[low + j] for i, j in pairs) and pairs == sorted(set(pairs))
                    if len(pairs) >= ls.MIN_COVERAGE * len(template):
                        got[place] = len(pairs)
            assert got == want, (name, raw)


def test_long_texts_are_scanned_in_blocks(index, monkeypatch):
    rng = random.Random(16)
    parts = [w for _ in range(40) for w in (prose(rng, rng.randrange(60)), re.sub(r"[\[\]]", "", ls.TEMPLATES[rng.choice(list(ls.TEMPLATES))]))]
    raw = "\n".join([*parts, "x" * 500, "été " * 90]).encode()
    whole = ls.scan(raw, index)
    monkeypatch.setattr(ls, "CONTEXT", 3000)
    for size in (7, 100, 5000):
        monkeypatch.setattr(ls, "BLOCK", size)
        assert ls.scan(raw, index) == whole and len(whole) > 20
