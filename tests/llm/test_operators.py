"""The corpus operators against brute force, on rows that hold the odd cases too."""

import binascii
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, golomb, language_id, license_scan, lz_fingerprint, mixing, near_dedup, packing, sharding, substring_dedup, suffix_dedup
from tessera.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, blob string, unit int"
EMPTY: list = []


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (300, 120, 80, 60, 40, 200)]
    near = base[0].split()
    near[50], near[150] = "changed", "words"
    passage = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[0]), (12, " ".join(near)), (13, base[1].replace(" ", "  \n")), (14, base[2] + " " + passage), (15, passage + "\n" + base[3])]
    rows += [(20, None), (21, ""), (22, " \t\n"), (23, "?!"), (24, "été \U0001f600 naïve"), (27, "one<|endoftext|> two <|endoftext|><|endoftext|>three"), (25, "a" * 300), (26, prose(rng, 9000)), (10, base[0]), (None, base[4]), (3, "another text under an id that repeats")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if k % 5 == 4 else "xx" if k % 2 else "yy", None if k % 7 == 6 else f"s{k % 3}", None, 1, "b", 2) for k, (i, t) in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame(EMPTY, SCHEMA)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, span in ((0, 10), (1, 1), (1, 1 << 44), (5, 5), (1000, 1 << 44), (1000, 1200)):
        v = np.sort(rng.choice(span, n, replace=False).astype(np.uint64)) if span < 1 << 30 else np.unique(rng.integers(0, span, n).astype(np.uint64))
        assert (golomb.decode(golomb.encode(v, span)) == v).all()
        parts = golomb.pack_by_owner(v, 44, 7)
        assert np.concatenate([np.zeros(0, np.uint64), *[golomb.unpack(p[3]) for p in parts]]).tolist() == v.tolist()
    a, b = np.array([1, 5, 9], np.uint64), np.array([5, 9, 77], np.uint64)
    blobs = [golomb.pack_by_owner(x, 44, 1)[0][3] for x in (a, b)]
    assert [np.unpackbits(np.frombuffer(x, np.uint8))[:3].tolist() for x in golomb.repeated_bitmaps([golomb.unpack(x) for x in blobs])] == [[0, 1, 1], [1, 1, 0]]


def test_exact_dedup(docs, nothing, texts):
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).select("doc_id", "n_chars", "keep_id", "group_size", "kept", "text_sha256").collect()]
    groups: dict = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), -1 if i is None else i))
    want = []
    for norm, rows in groups.items():
        rows.sort()
        keep = None if rows[0][1] == -1 else rows[0][1]
        want += [(None if i == -1 else i, -n, keep, len(rows), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (n, i) in enumerate(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_suffix_dedup(docs, nothing, texts):
    low = [(-1 if i is None else i, (t or "").encode()) for i, t in texts]
    first: dict = {}
    for i, raw in low:
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], i))
    want = []
    for i, raw in low:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((None if i == -1 else i, len(raw), kept))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def _plain_repeats(data, at, count, ids):
    first = {}
    for a, n, i in zip(at, count, ids, strict=True):
        for p in range(a, a + n):
            first[data[p : p + 50].tobytes()] = min(i, first.get(data[p : p + 50].tobytes(), i))
    return [first[data[p : p + 50].tobytes()] < i for a, n, i in zip(at, count, ids, strict=True) for p in range(a, a + n)]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghij"])
def test_blockwise_suffix_sorting(monkeypatch, letters):
    """Few letters make long ties; small buckets, chunks and rounds make every loop turn."""
    monkeypatch.setattr(suffix_dedup, "SORT_AT_ONCE", 16)
    monkeypatch.setattr(suffix_dedup, "_ROUNDS", 2)
    rng = random.Random(2)
    raw = ["".join(rng.choice(letters) for _ in range(rng.randrange(50, 90))) for _ in range(20)]
    period = "".join(rng.choice(letters) for _ in range(9)) * 12
    raw += [*raw[:5], period, period[3:], period[:60] + "x" + period[:50], raw[0][:30] + raw[1][-55:]]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    size = np.array([len(r) for r in raw])
    at, count, ids = np.cumsum(size) - size, size - 49, np.array([rng.randrange(9) for _ in raw])
    assert suffix_dedup.repeats(data, at, count, ids).tolist() == _plain_repeats(data, at, count, ids)


def test_frequent_keys_are_parted_alike(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 64)
    rng = random.Random(3)
    shared = "".join(rng.choice("ab ") for _ in range(90))
    texts = [prose(rng, 20) + shared + prose(rng, 20) for _ in range(6)] + ["ab" * 90, "x" + "ab" * 90]
    met: dict = {}
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        key = suffix_dedup.string_keys(data)
        for p, k in enumerate(suffix_dedup.part_keys(data, np.arange(len(key)), key).tolist()):
            met.setdefault(text[p : p + 50], set()).add(k)
    assert all(len(k) == 1 for k in met.values()) and len(met) > 200


@pytest.mark.parametrize("edits", [3, 40])
def test_passages_of_two_units_go_in_few_bytes(edits):
    """Near copies in pairs of units: what a unit sends for its suffixes is less than their text, not several times as much."""
    rng = random.Random(5)
    units, owners, groups = 64, 5, 16
    texts: list = [[] for _ in range(units)]
    for i in range(2 * units):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(4000))
        a, b = rng.sample(range(units), 2)
        texts[a].append((2 * i, text))
        cut = sorted(rng.sample(range(4000), edits))
        texts[b].append((2 * i + 1, "".join(text[x + 1 : y] + "#" for x, y in zip([-1, *cut], [*cut, 4000], strict=True))))
    pdfs = [pd.DataFrame({"unit": u, "doc_id": [i for i, _ in t], "raw": [x.encode() for _, x in t]}) for u, t in enumerate(texts)]
    keys = pd.concat([suffix_dedup._send_keys(owners)(p) for p in pdfs if len(p)])
    answers = pd.concat([suffix_dedup._answer(groups, units // 8)(g.reset_index(drop=True)) for _, g in keys.groupby("owner")])
    asked = pd.concat([suffix_dedup._send_suffixes(owners, groups)(p, answers[answers["unit"] == u].reset_index(drop=True)) for u, p in enumerate(pdfs)])
    asked["settled"] = asked["settled"].astype(bool)
    assert asked[~asked["settled"]]["blob"].map(len).sum() < sum(len(x) for t in texts for _, x in t)
    ranges = pd.concat([suffix_dedup._sort_group(g.reset_index(drop=True)) for _, g in asked.groupby("bucket")])
    got = {r.doc_id: [tuple(x) for x in r.spans] for u, p in enumerate(pdfs) for r in suffix_dedup._cut(p, ranges[ranges["unit"] == u].reset_index(drop=True)).itertuples()}
    first: dict = {}
    every = sorted(r for t in texts for r in t)
    for i, t in every:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in every:
        gone = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p + 1 : p + 51] = 1
        edge = np.flatnonzero(np.diff(gone))
        assert got[i] == list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def test_keys_are_dealt_evenly():
    """The least hash of a string is a small number; the first owner of keys had most of them, and the first group most suffixes."""
    rng = random.Random(6)
    data = np.frombuffer("".join(rng.choice("abcdefghijklmnop ") for _ in range(200_000)).encode(), np.uint8)
    keys = np.unique(suffix_dedup.string_keys(data))
    for owners in (12, 51, 600):
        dealt = np.bincount(golomb.owner_of(keys, suffix_dedup.KEY_BITS, owners), minlength=owners)
        assert len(dealt) == owners and dealt.max() < 2.5 * len(keys) / owners
    hashes = np.unique(suffix_dedup.gram_keys(data))
    assert len(np.unique(suffix_dedup.scattered(hashes))) == len(hashes)


def test_what_is_sent_comes_back():
    text, place, number, ids = np.array([0, 0, 3, 9]), np.array([5, 90, 7, 0]), np.array([1, 3, 1, 2]), np.array([suffix_dedup._NULL, suffix_dedup._NULL, -4, (1 << 63) - 1])
    data = np.arange(203).astype(np.uint8)
    for sent in ((text, place, number, ids, data), tuple(x[:0] for x in (text, place, number, ids, data))):
        for a, b in zip(sent, suffix_dedup._spread(suffix_dedup._squeezed(*sent)), strict=True):
            assert a.tolist() == b.tolist()


def test_holders_name_sets_of_units():
    sent = [np.array(v, np.uint64) for v in ([1, 5, 9], [2, 5, 9, 11], [], [9, 11], [1, 5])]
    value, times, who = suffix_dedup.holders(sent, np.array([4, 0, 1, 7, 2]))
    assert value.tolist() == [1, 5, 9, 11] and times.tolist() == [2, 3, 3, 2] and len(set(who.tolist())) == 4
    other = suffix_dedup.holders([sent[k] for k in (3, 4, 0, 1)], np.array([7, 2, 4, 0]))
    assert [x.tolist() for x in other] == [value.tolist(), times.tolist(), who.tolist()]
    assert all(len(x) == 0 for x in suffix_dedup.holders([np.zeros(0, np.uint64)], np.array([3])))


@pytest.mark.parametrize("many", [2, 1000])
def test_suffix_dedup_in_small_pieces(spark, monkeypatch, many):
    """Chunks and buckets of few bytes, keys parted or not, against brute force."""
    for name, value in (("_CHUNK", 256), ("SORT_AT_ONCE", 64), ("MANY_UNITS", many), ("MANY_RUNS", 1)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(4)
    shared = [prose(rng, 30) for _ in range(3)]
    rows = [(k, " ".join([prose(rng, rng.randrange(40)), rng.choice(shared), prose(rng, 9), "ab" * 40][: rng.randrange(1, 5)])) for k in range(60)]
    first: dict = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    want = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup(docs, nothing):
    got = near_dedup.near_duplicates(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["class_id"] == 0 for i in (0, 10, 11, 12)) and by[1][0]["class_id"] == by[13][0]["class_id"] == 1
    assert len({by[i][0]["class_id"] for i in (0, 1, 2, 4, 5, 15)}) == 6
    assert by[20][0]["class_id"] == by[21][0]["class_id"] == 20 and by[22][0]["class_id"] == 22 and by[23][0]["class_id"] == 23
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_dedup_of_short_texts_and_scattered_edits(spark):
    """Texts of few words with any one word changed or added, and longer ones with a fifth or less of their words changed."""
    rng, rows, base_of = random.Random(11), [], {}

    def add(words, base=None):
        rows.append((len(rows), " ".join(words)))
        base_of[len(rows) - 1] = len(rows) - 1 if base is None else base
        return len(rows) - 1

    for n in range(5, 17):
        words = prose(rng, n, 10**6).split()
        base = add(words)
        for k in range(n):
            add([*words[:k], f"new{n}x{k}", *words[k + 1 :]], base)
            add([*words[:k], f"more{n}x{k}", *words[k:]], base)
    exact = len(rows)
    for n in (40, 100, 300):
        for share in (0.1, 0.15, 0.19):
            for i in range(15):
                words = prose(rng, n, 10**6).split()
                base = add(words)
                for k in rng.sample(range(n), int(n * share)):
                    words[k] = f"new{n}x{round(share * 100)}x{i}x{k}"
                add(words, base)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, c in got.items() if i < exact} == {i: b for i, b in base_of.items() if i < exact}
    assert all(got[i] in (i, base_of[i]) for i in got) and sum(got[i] == base_of[i] for i in got if i >= exact) >= 0.97 * (len(rows) - exact)


def _plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize(("block", "large"), [(2000, 20_000), (6, 20_000), (4, 6)])
def test_near_dedup_against_all_pairs(spark, monkeypatch, block, large):
    """A passage that all share, copies and edited ones, with buckets compared at once, in blocks or parted by rare words."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rng, texts = random.Random(23), []
    passage = prose(rng, 60, 10**6).split()
    for k in range(60):
        own = prose(rng, rng.randrange(20, 90), 10**6).split()
        texts.append([*own[: len(own) // 2], *passage, *own[len(own) // 2 :]] if k % 4 else own)
        for _ in range(rng.randrange(3)):
            texts.append([w if rng.random() > rng.choice((0.02, 0.1)) else f"new{rng.randrange(10**6)}" for w in texts[-1]])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900 + k, " ".join(texts[k])) for k in range(30)]
    root = {k: k for k in range(len(texts))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            short, long = sorted((len(texts[a]), len(texts[b])))
            if short >= 0.8 * long and len(set(texts[a]) & set(texts[b])) >= 0.7 * long and _plain_common(texts[a], texts[b]) >= 0.8 * long:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["class_id"] == find(k) for k in root) and all(got[900 + k]["class_id"] == find(k) for k in range(30))
    size: dict = {}
    for k, _ in rows:
        size.setdefault(got[k]["class_id"], []).append(k)
    assert all(got[k]["class_size"] == len(own) and got[k]["kept"] == (k == c) for c, own in size.items() for k in own)


@pytest.mark.parametrize("rows", [1, 200])
def test_members_of_buckets_are_shuffled_once(spark, monkeypatch, rows):
    """Buckets in parts and whole ones: numbers and centres as counted plainly, and no join of all sketches."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", rows)
    rng = random.Random(12)
    # Bucket 7 is in every text, some buckets are in a few, most in one.
    held = {node: {7, *(rng.randrange(100, 900) for _ in range(5)), *(rng.getrandbits(60) for _ in range(10))} for node in range(400)}
    sketches = spark.createDataFrame([(node, 10 + node % 5, sorted(keys)) for node, keys in held.items()], "node long, n_words int, sketch array<long>")
    joined = []
    plain = near_dedup.salted_join
    monkeypatch.setattr(near_dedup, "salted_join", lambda *a: joined.append(a) or plain(*a))
    found = near_dedup.bucket_members(sketches.select("node", "n_words", F.explode("sketch").alias("bucket")))
    got = sorted(tuple(r) for r in found.select("bucket", "node", "n_words", "n", "centre", "n_centre").collect())
    nodes: dict = {}
    for node, keys in held.items():
        for k in keys:
            nodes.setdefault(k, []).append(node)
    assert got == sorted((k, x, 10 + x % 5, len(own), min(own), 10 + min(own) % 5) for k, own in nodes.items() if len(own) > 1 for x in own)
    assert not joined


def test_long_texts_are_sketched_in_blocks(monkeypatch):
    words = near_dedup.word_hashes(prose(random.Random(24), 3000, 40))
    whole = [near_dedup.order_sketches(words, k).tolist() for k in (2, 3, 5)]
    monkeypatch.setattr(near_dedup, "_COLUMNS", 128)
    assert [near_dedup.order_sketches(words, k).tolist() for k in (2, 3, 5)] == whole


def test_recall_by_similarity_and_length():
    """Pairs of random words with words replaced, left out or put in at random places: how many agree in a key."""
    rng = random.Random(25)
    for n in (20, 40, 100, 200):
        met = total = 0
        for _ in range(250):
            a = [rng.randrange(10**9) for _ in range(n)]
            b = list(a)
            for _ in range(rng.randrange(1, n // 5 + 1)):
                k = rng.randrange(len(b))
                b[k : k + 1] = rng.choice(([rng.randrange(10**9)], [], [b[k], rng.randrange(10**9)]))
            a, b = np.array(a, np.uint64), np.array(b, np.uint64)
            if 0.8 <= near_dedup.similarity(a.astype(np.uint32), b.astype(np.uint32)) <= 0.9:
                total += 1
                met += bool(np.intersect1d(near_dedup.bucket_keys(a), near_dedup.bucket_keys(b)).size)
        assert total > 50 and met >= 0.95 * total, (n, met, total)


def test_tiny_texts_share_a_key_where_they_are_alike():
    rng = random.Random(12)
    for _ in range(400):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 15))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(5))
        a, b = np.array(a, np.uint64), np.array(b[:14], np.uint64)
        if len(b) and near_dedup.similarity(a.astype(np.uint32), b.astype(np.uint32)) >= near_dedup.THRESHOLD:
            assert np.intersect1d(near_dedup.left_out(a), near_dedup.left_out(b)).size


def test_similarity_against_plain_alignment():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randrange(25) for _ in range(rng.choice([1, 30, 300]))]
        b = [x for x in a if rng.random() > 0.08] + [rng.randrange(25) for _ in range(rng.randrange(9))]
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
        plain = row[-1] / max(len(a), len(b))
        mine = near_dedup.similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert mine == plain if plain >= 0.8 else mine < 0.8


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}
    for _ in range(99):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_packing(spark, docs, nothing, texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    ids_of = packing.tokenizer_of(path)
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts)
    assert sorted(ids_of(t or "").tolist() for _, t in texts) == want
    pieces = packing.pack_documents(docs, path).collect()
    windows: dict = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], len(p["ids"])))
    for own in windows.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert sum(sum(n for _, n in own) < 2048 for own in windows.values()) <= docs.rdd.getNumPartitions()
    assert sorted(i for p in pieces for i in p["ids"]) == sorted(i for w in want for i in w)
    one = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == 26)
    assert sum((list(i) for _, i in one), []) == ids_of(dict(texts)[26]).tolist()
    digest = {(r["doc_id"], r["start"], r["length"]): r["ids_crc32"] for r in packing.piece_digests(packing.pack_documents(docs.where("doc_id = 26"), path)).collect()}
    assert all(c == binascii.crc32(ids_of(dict(texts)[26])[s : s + n].astype("<u4").tobytes()) for (_, s, n), c in digest.items())
    assert packing.pack_documents(nothing, path).count() == 0


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    ids_of = packing.tokenizer_of(packing.default_tokenizer())
    text = prose(random.Random(8), 500) + " plain words only here " * 50
    whole = ids_of(text).tolist()
    monkeypatch.setattr(packing, "PART_CHARS", 100)
    assert packing.tokenizer_of(packing.default_tokenizer())(text).tolist() == whole


def test_sharding(docs, nothing, texts):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    keys = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    moved = (sharding.jump(keys, 9) != sharding.jump(keys, 8)).mean()
    assert 0.09 < moved < 0.13 and np.bincount(sharding.jump(keys, 8)).min() > 2200

    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    assert [plain(int(k), 8) for k in keys[:300]] == sharding.jump(keys[:300], 8).tolist()
    assert sharding.shard_documents(nothing).count() == 0


def test_language_id(spark, docs, nothing):
    words = {"en": "the house of a king is in that town", "de": "das haus von einem koenig ist in der stadt", "fr": "la maison du roi est dans cette ville"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang) for i in range(90) for lang in [rng.choice(list(words))]]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(known.where(~language_id.held_out()))
    got = {r["key"]: r for r in language_id.predict(known, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    odd = {r["key"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert all(odd[i] == "und" for i in (20, 21, 22, 23)) and odd[25] != "und"
    assert language_id.predict(nothing, language_id.train(nothing)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(nothing)).collect()} == {"und"}


def test_language_id_against_plain_naive_bayes(spark, monkeypatch):
    """Blocks and score batches of few characters turn every loop; blocks end where letters do, so n-grams are the same."""
    monkeypatch.setattr(language_id, "SCORE_AT_ONCE", 500)
    rng = random.Random(31)
    letters = {"xx": "abcdefg ", "yy": "defghij ", "zz": "ghijabk "}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 400))), lang) for i in range(120) for lang in [rng.choice(list(letters))]]
    rows = [(i, "x" + t, lang) for i, t, lang in rows]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        code = [ord(c) for c in " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "]
        for n in (1, 2, 3):
            for k in range(len(code) - n + 1):
                h = 0
                for c in code[k : k + n]:
                    h = (h * 0x01000193 + c + 1) % (1 << 32)
                h = (h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32)
                yield (h ^ (h >> 12)) % language_id.BUCKETS

    count, texts = {x: {} for x in letters}, dict.fromkeys(letters, 0)
    for i, t, lang in rows:
        if i % 2:
            texts[lang] += 1
            for g in grams(t):
                count[lang][g] = count[lang].get(g, 0) + 1
    total = {x: sum(c.values()) + 0.5 * language_id.BUCKETS for x, c in count.items()}
    model = language_id.train(known.where("doc_id % 2 = 1"))
    got = {r["key"]: r for r in language_id.predict(known, model).collect()}
    for i, t, _ in rows:
        score = {x: np.log(texts[x] / sum(texts.values())) + sum(np.log((count[x].get(g, 0) + 0.5) / total[x]) for g in grams(t)) for x in letters}
        best = max(score, key=score.get)
        posterior = 1 / sum(np.exp(v - score[best]) for v in score.values())
        assert abs(got[i]["score"] - posterior) < 1e-3 and (got[i]["lang_pred"] == best or abs(posterior - 0.5) < 1e-3)
    whole = language_id.score_batch(model, [t for _, t, _ in rows])[0]
    monkeypatch.setattr(language_id, "_BLOCK", 64)
    pieces = language_id.score_batch(model, [t for _, t, _ in rows])[0]
    assert sum(a == b for a, b in zip(whole, pieces, strict=True)) >= len(rows) - 3
    monkeypatch.setattr(language_id, "MODEL_LIMIT", language_id.BUCKETS * language_id.CELL_BYTES * 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.train(known)


def test_mixing(spark, docs, nothing):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(0, 60)), s, "x") for i in range(1500) for s in [rng.choice(["a", "a", "a", "b", "c", None])]]
    big = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mixing.mix(mixing.word_counts(big)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(mixing.word_counts(big)).collect()), key=repr)
    size: dict = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(t.split())
    weight = dict(zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True))
    target, open_, left = {}, set(size), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        if not (over := {s for s in open_ if share[s] > 3 * size[s]}):
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 * target[s] and r["source_size"] == size[s] and 0 <= r["copies"] <= 3 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) / target[s] - 1) < 0.01
    assert mixing.mix(mixing.word_counts(docs)).count() == docs.count()
    assert mixing.mix(mixing.word_counts(nothing)).count() == 0


def test_rates_solve_the_dual(spark, monkeypatch):
    """Rates are exp(lambda x size) up to the limit and meet the targets; too few steps are an error."""
    rng = random.Random(41)
    rows = [(s, rng.randrange(0, 90)) for s in ["a"] * 400 + ["b"] * 30 + [None] * 5]
    sizes = spark.createDataFrame(rows, "source string, size long")
    targets = mixing.source_targets(sizes)
    solved = {r["source"]: r for r in mixing.balance(sizes, targets).collect()}
    for source, r in solved.items():
        own = [n for s, n in rows if s == source]
        lam, mean = r["lam"], sum(own) / len(own)
        rate = [3.0 if r["full"] else min(3.0, np.exp(lam * n / mean)) for n in own]
        assert abs(sum(n * x for n, x in zip(own, rate, strict=True)) - r["target"]) <= 2e-6 * r["target"]
    assert abs(sum(r["target"] for r in solved.values()) - sum(n for _, n in rows)) < 1e-6 and solved[None]["full"]
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(ArithmeticError):
        mixing.balance(sizes, targets)
    many = spark.createDataFrame([(f"s{k:03}", k % 17) for k in range(300)], "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(many).collect()}
    level = max(r["target"] / (1, 2, 3)[k % 3] for k, (_, r) in enumerate(sorted(got.items())))
    assert all(abs(r["target"] - min(3.0 * r["source_size"], (1, 2, 3)[k % 3] * level)) < 1e-6 for k, (_, r) in enumerate(sorted(got.items())))


def test_lz_fingerprints(spark, docs, nothing, texts):
    def plain(data):
        seen, at, ends = set(), 0, []
        for e in range(1, len(data) + 1):
            if data[at:e] not in seen:
                seen.add(data[at:e])
                ends.append(e)
                at = e
        return ends + [len(data)] * (at < len(data))

    rng = random.Random(7)
    for data in [b"", b"a", b"a" * 50, b"abab" * 9, *(bytes(rng.randrange(97, 100) for _ in range(rng.randrange(200))) for _ in range(60))]:
        assert lz_fingerprint.parse(data)[0] == plain(data)
        other = data[: len(data) // 2] + b"xyz"
        assert lz_fingerprint.fingerprints(data.decode(), other.decode()) == (lz_fingerprint.fingerprint(data.decode()), lz_fingerprint.fingerprint(other.decode()))
    tie = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1] or ""]))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        own = lz_fingerprint.fingerprint(t)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, lz_fingerprint.fingerprint(edited), lz_fingerprint.likeness(own, lz_fingerprint.fingerprint(edited)), lz_fingerprint.likeness(own, lz_fingerprint.fingerprint(following))))
    got = lz_fingerprint.with_next(docs, 5).mapInArrow(lz_fingerprint._edit_and_compare, lz_fingerprint.FINGERPRINTS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert lz_fingerprint.with_next(nothing, 5).mapInArrow(lz_fingerprint._edit_and_compare, lz_fingerprint.FINGERPRINTS).count() == 0


def test_likeness_of_short_texts_is_the_share_of_their_phrases(monkeypatch):
    rng = random.Random(17)

    def phrases(text):
        data = text.encode()
        ends = lz_fingerprint.parse(data)[0]
        return {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(120))) for _ in range(2))
        x, y = phrases(a), phrases(b)
        assert max(len(x), len(y)) < lz_fingerprint.K
        got = lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b))
        assert abs(got - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12
    a = prose(rng, 3000, 50)
    b = a[: len(a) // 2] + prose(rng, 1500, 50)
    x, y = phrases(a), phrases(b)
    assert abs(lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b)) - len(x & y) / len(x | y)) < 0.25


def test_an_id_of_many_texts_is_dealt_over_blocks(spark):
    rows = [(7 if k % 2 else k, f"text {k} " * 5) for k in range(400)]
    dealt = lz_fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    own = dealt.where("not ahead").groupBy("block").count().collect()
    assert len(own) >= 6 and max(r["count"] for r in own) < 150
    assert dealt.mapInArrow(lz_fingerprint._edit_and_compare, lz_fingerprint.FINGERPRINTS).count() == 400


def test_substring_dedup(docs, nothing):
    got = {}
    for r in substring_dedup.remove_repeated_passages(docs).collect():
        got.setdefault(r["doc_id"], r)
    assert got[15]["spans"] and got[10]["spans"] == [[0, got[10]["n_bytes"]]] and got[15]["repeats_of"][0] in (3, 14)
    assert not any(got[i]["spans"] for i in (0, 1, 2, 5, 20, 21, 24, 26))
    assert sum(len(r["kept"]) + sum(b - a for a, b in r["spans"]) == r["n_bytes"] for r in got.values()) == len(got)
    raw = prose(random.Random(1), 400).encode()
    assert len({raw[a:b] for a, b in zip(*[iter(substring_dedup.chunk_ends(raw)[k:]) for k in (0, 1)])} - {(b"inserted " + raw)[a:b] for a, b in zip(*[iter(substring_dedup.chunk_ends(b"inserted " + raw)[k:]) for k in (0, 1)])}) <= 2
    assert substring_dedup.remove_repeated_passages(nothing).count() == 0


def _plain_passages(rows, least):
    """Removed bytes by chunks compared as bytes."""
    cut = {}
    for k, (i, t) in enumerate(rows):
        ends = substring_dedup.chunk_ends(t).tolist()
        cut[k] = (i, [(a, b) for a, b in zip([0, *ends], ends, strict=False)])
    first: dict = {}
    for k, (i, chunks) in cut.items():
        for a, b in chunks:
            first[rows[k][1][a:b]] = min(i, first.get(rows[k][1][a:b], i))
    out = []
    for k, (i, chunks) in cut.items():
        t, marked = rows[k][1], bytearray(len(rows[k][1]))
        for a, b in chunks:
            if first[t[a:b]] < i:
                marked[a:b] = b"\1" * (b - a)
        kept, at = b"", 0
        while at < len(t):
            stop = at
            while stop < len(t) and marked[stop] == marked[at]:
                stop += 1
            if not marked[at] or (stop - at < least and stop - at < len(t)):
                kept += t[at:stop]
            at = stop
        out.append((i, kept))
    return sorted(out)


@pytest.mark.parametrize(("block", "most", "least"), [(1 << 20, 4096, substring_dedup.MIN_RUN), (300, 120, substring_dedup.MIN_RUN), (1 << 20, 4096, 0)])
def test_substring_dedup_against_plain_chunks(spark, monkeypatch, block, most, least):
    """Hot passages, one-chunk copies, fillers; blocks and longest chunks of few bytes turn every loop."""
    monkeypatch.setattr(substring_dedup, "_BLOCK", block)
    monkeypatch.setattr(substring_dedup, "MOST", most)
    rng = random.Random(21)
    shared = [prose(rng, n) for n in (9, 30, 200)]
    rows = [(k, " ".join([prose(rng, rng.randrange(60)), rng.choice(shared), prose(rng, 9)][: rng.randrange(1, 4)])) for k in range(300)]
    rows += [(900 + k, t) for k, t in enumerate(["a" * 300, "a" * 300, "one line of thirty-eight letters alone", "one line of thirty-eight letters alone", "x" + "a" * 9000, "yy" + "a" * 9000, "", ""])]
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in got) == _plain_passages([(i, t.encode()) for i, t in rows], least)
    by = {r["doc_id"]: r for r in got}
    assert not by[901]["kept"] and not by[903]["kept"] and by[900]["kept"] and by[902]["kept"]


def test_chunks_do_not_depend_on_blocks(monkeypatch):
    raw = prose(random.Random(22), 4000).encode() + b"-" * 5000
    whole = substring_dedup.chunk_ends(raw).tolist()
    monkeypatch.setattr(substring_dedup, "_BLOCK", 512)
    assert substring_dedup.chunk_ends(raw).tolist() == whole
    assert max(b - a for a, b in zip([0, *whole], whole, strict=False)) <= substring_dedup.MOST


def test_license_scan(spark, docs, nothing):
    rng = random.Random(2)
    notice = license_scan.TEMPLATES["MIT text"].split()
    changed = [w for k, w in enumerate(notice) if k % 17]
    rows = [(1, prose(rng, 50) + "\nReleased under the  MIT license.\n" + prose(rng, 50)), (2, "x " + " ".join(changed)), (3, prose(rng, 99)), (4, "Licensed under CC BY-NC 4.0. and Licensed under CC BY-NC 4.0"), (5, "under the license"), (6, None)]
    got = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert dict(rows)[r["doc_id"]][r["start_char"] : r["end_char"]] == r["span"]
    assert {i: [r["license"] for r in x] for i, x in got.items()} == {1: ["MIT"], 2: ["MIT text"], 4: ["CC-BY-NC-4.0"] * 2}
    assert got[2][0]["matched_words"] == len(changed) or got[2][0]["coverage"] > 0.9
    assert license_scan.scan_licenses(nothing).count() == 0 and license_scan.scan_licenses(docs).count() == 0


def test_functions_load_where_the_package_is_missing(tmp_path):
    """What is sent to executors has no need of an installed copy."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    functions = [
        near_dedup._sketch, near_dedup._compare, near_dedup._verify, near_dedup._terms, near_dedup._words, lz_fingerprint._edit_and_compare, license_scan._scanner(license_scan.Index(license_scan.TEMPLATES)),
        suffix_dedup._send_keys(3), suffix_dedup._send_suffixes(3, 4), suffix_dedup._sort_group, suffix_dedup._cut, packing._packer("x", 9), language_id._counter, substring_dedup._chunks, mixing._round_block, exact_dedup._sender(3),
    ]
    for k, f in enumerate(functions):
        (tmp_path / str(k)).write_bytes(cloudpickle.dumps(f))
    load = f"import pickle; [pickle.load(open('{tmp_path}/' + str(k), 'rb')) for k in range({len(functions)})]"
    subprocess.run([sys.executable, "-c", load], cwd=tmp_path, check=True)


def test_salted_join_joins_no_row_but_to_its_group(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") < 30_000, 7).when(F.col("id") < 39_000, F.col("id") % 500 + 10).cast("long").alias("k"), F.col("id").alias("v"))
    groups = spark.range(300).select(F.col("id").cast("int").alias("k"), (F.col("id") * 3).alias("g"))
    for how in ("inner", "left"):
        got = common.salted_join(rows, groups, "k", "v", how=how)
        assert sorted(map(tuple, got.select("k", "v", "g").collect()), key=repr) == sorted(map(tuple, rows.join(groups, "k", how).select("k", "v", "g").collect()), key=repr)
        # The parts of frequent keys are told without a join of all rows.
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
