"""Removal of repeated byte strings by sorting suffixes bucket by bucket.

A byte goes when a string of LENGTH bytes that covers it also starts in a
document with a smaller id.  All suffixes of all texts, compared over LENGTH
bytes, would have to be sorted; these steps sort one bucket of them at a time
and only those that can meet an equal one:

1. Meeting.  Texts lie dealt over units.  Of each LENGTH-byte string the
   GRAM-byte string in it with the least hash is its key, the same wherever the
   string occurs.  A unit sends its distinct keys, Golomb coded, to owners of
   key ranges and gets back bitmaps of those that other units have too, and
   where they go: keys that few units have go by the set of these units.
2. Blockwise sorting.  Suffixes whose key repeats are sorted inside their unit:
   places whose residue modulo V is in a difference cover are samples, and the
   samples' strings are ranked first.  Then the suffixes go through in buckets
   by their leading bytes, one bucket at a time: they are ordered by their first
   and last 8 bytes, and ties are resolved by the ranks of the samples that two
   suffixes have at a common distance, which any two residues have within V
   bytes.  A suffix is never spelt out, so a bucket holds some 40 bytes of each
   of its suffixes.  What has an equal of a smaller id in the unit is settled.
3. The rest goes, in runs with the bytes around, to the task of its key, and is
   sorted there by the same routine.  Neighbouring keys of a passage that two
   units share have the same set of units, so the passage goes in one run; by
   their own hashes the keys would break it every 14 bytes or so, with LENGTH - 1
   bytes more each time.  Keys of more than FEW_UNITS units go by their hashes: a
   passage that a third of all documents share leaves each unit once.  A key that
   many units have in MANY_RUNS places each, as a frequent phrase gives, is parted
   by the bytes before or after the key's string: the side of which the suffix
   holds more.
4. Ranges to remove come back to the units, which cut the texts.

(The keys of step 1 are by content and not by residues: to bring equal strings
of different tasks together a residue cover would send every suffix to the tasks
of all its samples.)

Memory follows a unit's texts and one bucket of suffixes.  Texts are shuffled
once, and that shuffle is read three times.

Defined results: a null text is the empty text; texts shorter than LENGTH stay
whole; equal texts: all but those with the smallest id go; rows that share an
id don't remove each other's bytes; a null id is the smallest; an empty table
gives an empty table; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, shuffle_partitions
from tessera.llm.golomb import bitmap, owner_of, pack_by_owner, unpack, values_of_many
from tessera.llm.hashing import mix, powers, prefix_hash, run_hashes

LENGTH = 50
GRAM = 25
KEY_BITS = 44
#: An odd number: products modulo 2**KEY_BITS differ where the factors do.
SCATTER = np.uint64(0x9E3779B97F5)
#: Units for each shuffle partition; a task has one of them in memory at a time.
UNITS = 4
#: Groups of keys for each shuffle partition; a task has one of them in memory at a time.  Each unit may send to each group, so more of them are more rows.
GROUPS = 2
#: Keys that so many units have at most, and an eighth of all units, go by the set of these units.
FEW_UNITS = 8
#: Keys that so many units have in so many places each are parted by CONTEXT bytes beside their strings.
MANY_UNITS = 32
MANY_RUNS = 8
CONTEXT = 13
#: A bucket has so many suffixes, or a sixteenth of them if that is more.
SORT_AT_ONCE = 1 << 16
#: A difference cover: any two residues modulo V have a common distance to residues in it.
V, COVER = 7, (1, 2, 4)
#: Bytes of a sample that are ranked.
RANKED = LENGTH - V + 1
#: Rounds in which ties are compared with one suffix of theirs.
_ROUNDS = 8
_CHUNK = 1 << 18
_NULL = -(1 << 63)


class Unit:
    """The texts of one unit: in order of id, equal ones once, laid end to end."""

    def __init__(self, pdf: pd.DataFrame):
        ids = pdf["doc_id"].fillna(_NULL).astype("int64") if pdf["doc_id"].isna().any() else pdf["doc_id"].astype("int64")
        order = sorted(range(len(pdf)), key=lambda i, d=ids.tolist(), t=pdf["raw"].tolist(): (d[i], t[i]))
        self.rows = [(int(ids.iloc[i]), pdf["raw"].iloc[i]) for i in order]
        first: dict[bytes, int] = {}
        self.lead: list[int] = []  # for each row the place of the text that stands for it
        texts: list[bytes] = []
        doc_ids: list[int] = []
        for doc_id, raw in self.rows:
            if raw not in first:
                first[raw] = len(texts)
                texts.append(raw)
                doc_ids.append(doc_id)
            self.lead.append(first[raw])
        self.doc_ids = np.array(doc_ids, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of suffixes with the same key: text, first place, number, key."""
        found = list(self._runs())
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def _runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        own = np.flatnonzero(self.end > self.start)
        begin, stop = self.start[own], np.maximum(self.start[own], self.end[own] - LENGTH + 1)
        for low in range(0, len(self.bytes) - LENGTH + 1, _CHUNK):
            part = self.bytes[low : low + _CHUNK + LENGTH - 1]
            key = string_keys(part)
            edge = np.zeros(len(key) + 1, bool)
            edge[[0, -1]] = True
            edge[1:-1] = key[1:] != key[:-1]
            for at in (begin, stop):  # where texts begin, and where no suffix is long enough any more
                edge[at[np.searchsorted(at, low) : np.searchsorted(at, low + len(key))] - low] = True
            cut = np.flatnonzero(edge)
            head, count = cut[:-1], np.diff(cut)
            text = np.searchsorted(begin, head + low, "right") - 1
            whole = head + low < stop[text]
            yield own[text[whole]], head[whole] + low, count[whole], key[head[whole]]


def gram_keys(part: np.ndarray) -> np.ndarray:
    """The hash of each GRAM-byte string."""
    prefix = prefix_hash(part)
    return mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix), True)[: len(prefix) - GRAM]) >> np.uint64(64 - KEY_BITS)


def string_keys(part: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte string the least hash of the GRAM-byte strings in it, scattered."""
    least = gram_keys(part)
    width, need = 1, LENGTH - GRAM + 1
    while width < need:
        step = min(width, need - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return scattered(least)


def scattered(hashes: np.ndarray) -> np.ndarray:
    """Other numbers for the hashes, one to one: the least of 26 are small, and the first owners would have most of them."""
    return hashes * SCATTER & np.uint64((1 << KEY_BITS) - 1)


def _distances() -> np.ndarray:
    """[a, b]: the least distance that takes both residues into the cover."""
    inside = np.isin(np.arange(2 * V) % V, COVER)
    return np.array([[next(d for d in range(V) if inside[a + d] and inside[b + d]) for b in range(V)] for a in range(V)])


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, as one number that sorts like them."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").ravel().astype(np.uint64)


def _words(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The `size` bytes at each place as such numbers; the last may overlap the one before."""
    return [_word(data, at + k) for k in [*range(0, size - 8, 8), size - 8]]


def _buckets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Which of the places belong together by their two leading bytes, bucket by bucket in the order of these."""
    lead = data[at].astype(np.uint16) << np.uint16(8) | data[at + 1]
    times = np.bincount(lead, minlength=1 << 16)
    before = np.cumsum(times) - times
    bucket = before // max(SORT_AT_ONCE, len(at) // 16)
    for low in np.unique(bucket[times > 0], return_index=True)[1]:
        first = int(np.flatnonzero(times > 0)[low])
        last = int(np.searchsorted(bucket, bucket[first], "right"))
        yield np.flatnonzero((lead >= first) & (lead < last))


def sample_ranks(data: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each sample that a suffix of the runs can reach, the rank of its RANKED bytes among all; 0 at other places."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + count + V - 1, -1)
    place = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & np.resize(np.isin(np.arange(V), COVER), len(data)))
    rank, given = np.zeros(len(data), np.int32), 0
    for own in _buckets(data, place) if len(place) else ():
        words = _words(data, place[own], RANKED)
        order = np.lexsort(words[::-1])
        new = np.ones(len(own), bool)
        new[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0)
        rank[place[own[order]]] = np.cumsum(new) + given
        given += int(new.sum())
    return rank


def _settle(data: np.ndarray, at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A number for each suffix, equal for equal ones; those of a group (in order) agree in their first and last 8 bytes."""
    found, left = np.arange(len(at)), np.arange(len(at))
    distance = _distances()
    for _ in range(_ROUNDS):
        head = np.flatnonzero(np.append(True, group[left[1:]] != group[left[:-1]]))
        leader = np.repeat(left[head], np.diff(np.append(head, len(left))))
        a, b = at[left], at[leader]
        d = distance[a % V, b % V]
        same = rank[a + d] == rank[b + d]
        found[left[same]] = leader[same]
        left = left[~same]
        if not len(left):
            return found
    # Groups of many different strings: by all their bytes.
    words = _words(data, at[left], LENGTH)
    order = np.lexsort((*words[::-1], group[left]))
    new = np.ones(len(left), bool)
    new[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in [*words, group[left]]], axis=0)
    found[left[order]] = left[order][np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
    return found


def repeats(data: np.ndarray, at: np.ndarray, count: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """For each suffix of the runs, in their order, whether its LENGTH bytes also occur in a run of a smaller id."""
    run = np.repeat(np.arange(len(at)), count)
    place = suffixes(at, count)
    gone = np.zeros(len(place), bool)
    rank = sample_ranks(data, at, count)
    for own in _buckets(data, place) if len(place) else ():
        first, last = _word(data, place[own]), _word(data, place[own] + LENGTH - 8)
        order = np.lexsort((last, first))
        same = (first[order[1:]] == first[order[:-1]]) & (last[order[1:]] == last[order[:-1]])
        tied = np.append(False, same) | np.append(same, False)
        own, group = own[order[tied]], np.cumsum(np.append(True, ~same))[tied]
        if not len(own):
            continue
        found, ids = _settle(data, place[own], group, rank), doc_id[run[own]]
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, found, ids)
        gone[own] = ids > least[found]
    return gone


def suffixes(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of the runs' suffixes."""
    return np.arange(int(count.sum())) + np.repeat(at - np.cumsum(count) + count, count)


def _ranges(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first row and number of each run of rows whose first column goes up by one and whose others stay."""
    place, *others = columns
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1] + 1
    for x in others:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(place))).astype(np.int32)


def part_keys(data: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Finer keys for suffixes of frequent ones: with the CONTEXT bytes beside the key's string, on the side of which a suffix has more."""
    order = np.lexsort((place, key))
    inorder, at = key[order], place[order]
    distinct, which = np.unique(inorder, return_inverse=True)
    # Where the keys' strings are; a suffix goes by the first one from its place on.
    found: list[np.ndarray] = []
    named: list[np.ndarray] = []
    for low in range(0, len(data) - GRAM + 1, _CHUNK):
        grams = scattered(gram_keys(data[low : low + _CHUNK + GRAM - 1]))
        slot = np.minimum(np.searchsorted(distinct, grams), len(distinct) - 1)
        hit = np.flatnonzero(distinct[slot] == grams)
        found.append(hit + low)
        named.append(slot[hit])
    spot, name = np.concatenate(found), np.concatenate(named)
    by = np.lexsort((spot, name))
    table = (name[by].astype(np.int64) << 40) + spot[by]
    string = table[np.searchsorted(table, (which.astype(np.int64) << 40) + at)] & ((1 << 40) - 1)
    after = string - at <= LENGTH - GRAM - CONTEXT
    begin = np.where(after, string + GRAM, string - CONTEXT)
    context = run_hashes(prefix_hash(data), begin, begin + CONTEXT)
    out = np.empty(len(place), np.uint64)
    out[order] = mix(context ^ inorder ^ np.where(after, np.uint64(1 << 62), np.uint64(0))) >> np.uint64(64 - KEY_BITS)
    return out


def _send_keys(owners: int):
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, runs = np.unique(Unit(pdf).runs()[3], return_counts=True)
        often = {s[0]: s[3] for s in pack_by_owner(keys[runs >= MANY_RUNS], KEY_BITS, owners)}
        sent = pack_by_owner(keys, KEY_BITS, owners)
        return pd.DataFrame({"unit": int(pdf["unit"].iloc[0]), "owner": [s[0] for s in sent], "blob": [s[3] for s in sent], "often": [often.get(s[0], b"") for s in sent]})

    return send


def holders(sent: list[np.ndarray], units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values that several units have, in order, with the number of these units and a hash of their set."""
    every = np.concatenate([np.zeros(0, np.uint64), *sent])
    who = np.repeat(mix(units.astype(np.uint64) + np.uint64(1)), [len(v) for v in sent])
    order = np.argsort(every, kind="stable")
    every = every[order]
    head = np.flatnonzero(np.append(np.ones(min(1, len(every)), bool), every[1:] != every[:-1]))
    times = np.diff(np.append(head, len(every)))
    again = times > 1
    return every[head[again]], times[again], mix(np.add.reduceat(who[order], head)[again]) if len(head) else every


def _goal_type(groups: int) -> np.dtype:
    return np.min_scalar_type(groups).newbyteorder("<")


def _answer(groups: int, few: int):
    """To each unit: which of its keys others have too, which are to be parted, and for the first the group that they go to (`groups`: the one of their hash)."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [unpack(b) for b in pdf["blob"]]
        many = values_of_many([unpack(b) for b in pdf["often"] if b], MANY_UNITS)
        again, times, who = holders(sent, pdf["unit"].to_numpy())
        goal = np.where(times <= few, who % np.uint64(groups), np.uint64(groups))
        goal[np.isin(again, many)] = groups
        goal = goal.astype(_goal_type(groups))
        out = []
        for v in sent:
            at = np.searchsorted(again, v)
            hit = again[np.minimum(at, len(again) - 1)] == v if len(again) else np.zeros(len(v), bool)
            out.append((np.packbits(hit).tobytes(), bitmap(v, many), goal[at[hit]].tobytes()))
        return pd.DataFrame({"unit": pdf["unit"], "owner": pdf["owner"]} | dict(zip(("bits", "many", "goals"), map(list, zip(*out, strict=True)), strict=True)))

    return answer


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)


def _unblob(blob: bytes, *types: str) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n, at = int.from_bytes(blob[at : at + 8], "little"), at + 8
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


_SUFFIXES = ("<i4", "<i4", "<i4", "<i8", "u1")  # text, place in it, number, doc_id, bytes
_RANGES = ("<i4", "<i4", "<i4")  # text, place in it, number


def _packed(kinds: tuple[str, ...], *arrays: np.ndarray) -> bytes:
    return _blob(*(a.astype(t) for a, t in zip(arrays, kinds, strict=True)))


def _squeezed(*arrays: np.ndarray) -> bytes:
    """The columns of _SUFFIXES, compressed; all but the bytes as differences, which are small as they come in order."""
    *columns, data = arrays
    blob = _packed(_SUFFIXES, *(np.diff(a.astype(np.int64), prepend=0) for a in columns), data)
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def _spread(blob: bytes) -> list[np.ndarray]:
    *columns, data = _unblob(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), *_SUFFIXES)
    return [*(np.cumsum(a, dtype=a.dtype) for a in columns), data]


def _send_suffixes(owners: int, groups: int):
    def send(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "unit", "settled", "blob"]
        if not len(texts):
            return pd.DataFrame(columns=columns)
        unit, name = Unit(texts), int(texts["unit"].iloc[0])
        text, at, count, key = unit.runs()
        if not len(text):
            return pd.DataFrame(columns=columns)
        distinct, inverse = np.unique(key, return_inverse=True)
        owner = owner_of(distinct, KEY_BITS, owners)
        elsewhere, many, goal = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool), np.full(len(distinct), groups)
        for o, bits, more, goals in zip(*(answers[c].tolist() for c in ("owner", "bits", "many", "goals")), strict=True):
            a, b = np.searchsorted(owner, [o, o + 1])
            elsewhere[a:b], many[a:b] = (np.unpackbits(np.frombuffer(x, np.uint8))[: b - a].astype(bool) for x in (bits, more))
            goal[a:b][elsewhere[a:b]] = np.frombuffer(goals, _goal_type(groups))
        low, high = np.full(len(distinct), len(unit.doc_ids)), np.full(len(distinct), -1)
        np.minimum.at(low, inverse, text)
        np.maximum.at(high, inverse, text)
        wanted = np.flatnonzero((elsewhere | (low != high))[inverse])
        text, at, count, key, which = text[wanted], at[wanted], count[wanted], key[wanted], inverse[wanted]
        if not len(text):
            return pd.DataFrame(columns=columns)
        gone = repeats(unit.bytes, at, count, unit.doc_ids[text])
        run, place = np.repeat(np.arange(len(at)), count), suffixes(at, count)
        head, number = _ranges(place[gone], text[run[gone]])
        t, p = text[run[gone]][head], place[gone][head]
        out = [(name % groups, name, True, _packed(_RANGES, t, p - unit.start[t], number))]
        # Only where other units have the key is there more to find out.
        ask = np.flatnonzero(~gone & elsewhere[which][run])
        run, place = run[ask], place[ask]
        bucket = goal[which[run]]
        own = np.flatnonzero(bucket == groups)
        if len(own):
            single = key[run[own]]
            hot = np.flatnonzero(many[which[run[own]]])
            if len(hot):
                single[hot] = part_keys(unit.bytes, place[own[hot]], single[hot])
            bucket[own] = owner_of(single, KEY_BITS, groups)
        t = text[run]
        head, number = _ranges(place, t, bucket)
        p, t, bucket = place[head], t[head], bucket[head]
        by = np.argsort(bucket, kind="stable")
        t, p, bucket, number = t[by], p[by], bucket[by], number[by]
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            own = t[a:b]
            out.append((int(bucket[a]), name, False, _squeezed(own, p[a:b] - unit.start[own], number[a:b], unit.doc_ids[own], unit.bytes[suffixes(p[a:b], number[a:b] + LENGTH - 1)])))
        return pd.DataFrame(out, columns=columns)

    return send


def _sort_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle the suffixes of one group of keys; what the units have settled themselves passes through."""
    settled = pdf[pdf["settled"]]
    out = list(zip(settled["unit"].tolist(), settled["blob"].tolist(), strict=True))
    asked = pdf[~pdf["settled"]]
    parts = [_spread(b) for b in asked["blob"].tolist()]
    if parts:
        text, offset, count, doc_id, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        unit = np.repeat(asked["unit"].to_numpy(np.int64), [len(p[0]) for p in parts])
        size = count.astype(np.int64) + LENGTH - 1
        at = np.cumsum(size) - size
        gone = repeats(data, at, count, doc_id)
        run = np.repeat(np.arange(len(at)), count)[gone]
        place = suffixes(offset, count)[gone]
        head, number = _ranges(place, run)
        run, place = run[head], place[head]
        order = np.argsort(unit[run], kind="stable")
        run, place, number = run[order], place[order], number[order]
        for own in np.split(np.arange(len(run)), np.flatnonzero(np.diff(unit[run])) + 1) if len(run) else ():
            out.append((int(unit[run[own[0]]]), _packed(_RANGES, text[run[own]], place[own], number[own])))
    return pd.DataFrame(out, columns=["unit", "blob"])


def _cut(texts: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    unit = Unit(texts) if len(texts) else None
    if unit is None:
        return pd.DataFrame(columns=["doc_id", "n_bytes", "spans", "kept"])
    parts = [_unblob(b, *_RANGES) for b in ranges["blob"].tolist()]
    spans: list[list[tuple[int, int]]] = [[] for _ in unit.doc_ids]
    if parts:
        text, at, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, text))
        for t, a, b in zip(text[order].tolist(), at[order].tolist(), (at + count + LENGTH - 1)[order].tolist(), strict=True):
            own = spans[t]
            if own and a <= own[-1][1]:
                if b > own[-1][1]:
                    own[-1] = (own[-1][0], b)
            else:
                own.append((a, b))
    rows = []
    for (doc_id, raw), lead in zip(unit.rows, unit.lead, strict=True):
        cut = spans[lead]
        if doc_id != unit.doc_ids[lead] and len(raw) >= LENGTH:
            cut = [(0, len(raw))]
        kept = b"".join(raw[a:b] for a, b in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(raw)], strict=True)) if cut else raw
        rows.append((None if doc_id == _NULL else doc_id, len(raw), [[a, b] for a, b in cut], kept))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def _digest(texts: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    """_cut() with numbers and a digest instead of spans and bytes."""
    cut = _cut(texts, ranges)
    spans = cut["spans"].tolist()
    return pd.DataFrame(
        {
            "doc_id": cut["doc_id"], "n_bytes": cut["n_bytes"], "n_removed": [sum(b - a for a, b in s) for s in spans], "n_spans": [len(s) for s in spans],
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in cut["kept"].tolist()],
        }
    )


def _planned(docs: DataFrame, last, schema: str, id_col: str, text_col: str) -> DataFrame:
    partitions = shuffle_partitions(docs.sparkSession)
    units, groups = UNITS * partitions, GROUPS * partitions
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"), F.xxhash64(raw).alias("key"))
    # Copies share a unit, unless they would fill it: such texts are spread, and there are 2 x units of them at most.
    heavy = materialise(thin.groupBy("key").agg(F.sum(F.octet_length("raw")).alias("size")), "sizes")
    total = heavy.agg(F.sum("size")).first()[0] or 0
    spread = F.broadcast(heavy.where(F.col("size") > total / (2 * units)).select("key", F.lit(True).alias("spread")))
    salt = F.when(F.col("spread"), F.pmod(F.xxhash64("doc_id"), F.lit(units))).otherwise(F.lit(0).cast("long"))
    # Units, owners and groups are dealt in turn, so that every partition has as many of them.
    dealt = thin.join(spread, "key", "left").select(F.pmod(F.pmod("key", F.lit(units)) + salt, F.lit(units)).cast("int").alias("unit"), "doc_id", "raw").repartitionById(partitions, "unit")
    keys = dealt.groupBy("unit").applyInPandas(_send_keys(partitions), "unit int, owner int, blob binary, often binary").repartitionById(partitions, "owner")
    answers = keys.groupBy("owner").applyInPandas(_answer(groups, min(FEW_UNITS, units // 8)), "unit int, owner int, bits binary, many binary, goals binary").repartitionById(partitions, "unit")
    asked = dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInPandas(_send_suffixes(partitions, groups), "bucket int, unit int, settled boolean, blob binary").repartitionById(partitions, "bucket")
    ranges = asked.groupBy("bucket").applyInPandas(_sort_group, "unit int, blob binary").repartitionById(partitions, "unit")
    return dealt.groupBy("unit").cogroup(ranges.groupBy("unit")).applyInPandas(last, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (the removed ones, from and to in bytes) and kept (bytes)."""
    return _planned(docs, _cut, "doc_id long, n_bytes long, spans array<array<long>>, kept binary", id_col, text_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(documents(spark, sf_dir), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id", "text")
