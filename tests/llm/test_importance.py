"""Resampling by hashed n-grams against plain checksums and SQL."""

import binascii
import hashlib
import math
import random
import re

import duckdb
import pytest

from tessera.llm import importance as im

SCHEMA = "doc_id long, text string, raw string, bucket int, n long, part int, place long, may boolean, weight int, at int"


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, True, 5, 6) for r in rows], SCHEMA)


def grams(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target):
    source, wanted = [0] * im.BUCKETS, [0] * im.BUCKETS
    crc = lambda g: binascii.crc32(g.encode()) % im.BUCKETS
    for counts, texts in ((source, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            for g in grams(t)[1]:
                counts[crc(g)] += 1
    s_all, t_all = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + im.BUCKETS) / ((s + 1) * (t_all + im.BUCKETS)))) for s, t in zip(source, wanted, strict=True)]
    out = []
    for i, text in docs:
        words, own = grams(text)
        weight = sum(gain[crc(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(may[: 25 * len(may) // 100], 1)}
    return [(*r[:4], drawn.get(id(r))) for r in out]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    word = lambda: rng.choice(["Alpha", "beta", "été", "ÉTÉ", "x1", "don't", "日本", "naïve space", "\U0001f600", "İ"]) + rng.choice(["", "s", "-b", "_c", " ", ".\n"])
    rows = [(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(150)]
    return rows + [(500, None), (501, ""), (502, " .\n"), (None, "word " * 30), (7, rows[7][1]), (7, rows[8][1]), (503, "one two " * 9000), (504, "z" * 90_000), (505, "\x00a\x7fb")]


TARGET = ["Alpha beta x1", "été été alphas", None, ""]


def _key(row):
    return repr(row)


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_against_plain_checksums(spark, monkeypatch, docs, block):
    tables = im._moves()
    monkeypatch.setattr(im, "_BLOCK", block)
    for longest in (1, 2, 3):
        for _, text in docs[:60]:
            words, own = grams(text, longest)
            found = list(im.buckets((text or "").encode(), tables, longest, 1 << 32))
            assert sum(n for n, _ in found) == len(words)
            assert sorted(c for _, part in found for c in part.tolist()) == sorted(binascii.crc32(g.encode()) for g in own)


def test_moves_cancel_any_prefix():
    rng, tables = random.Random(2), im._moves()
    for size in (0, 1, 2, 255, 256, 100_000):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(size)
        moved = im.move(im.np.array([binascii.crc32(a)], im.np.uint32), im.np.array([size]), tables)
        assert int(moved[0]) ^ binascii.crc32(a + b) == binascii.crc32(b)


def test_resampling(spark, docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = [tuple(r) for r in im.resample(given(spark, docs).repartition(3), target).collect()]
    assert sorted(got, key=_key) == sorted(plain(docs, TARGET), key=_key)
    db = duckdb.connect()
    held = given(spark, docs).select("doc_id", "text").toArrow()  # noqa: F841
    wanted = target.toArrow()  # noqa: F841
    db.execute("create view documents as select * from held")
    db.execute("create view benchmark as select * from wanted")
    assert sorted(db.sql(im.OP11_SQL).fetchall(), key=_key) == sorted(got, key=_key)


def test_no_documents_and_no_target(spark, docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert im.resample(given(spark, []), target).count() == 0
    got = im.resample(given(spark, docs), target.where("false")).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(plain(docs, []), key=_key)
