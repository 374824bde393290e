"""Lempel-Ziv phrase fingerprints: how well would one text compress another?

A text's UTF-8 bytes are parsed into dictionary phrases (Ziv and Lempel, 1978):
each phrase is the longest one seen before and one byte more.  The phrase set
says what the text is made of; the smallest K of its phrases' hashes are the
fingerprint.  The likeness of two fingerprints is the share of phrases that the
two sets have in common: exact where both sets have fewer than K phrases, else
estimated from the K smallest hashes of both together.

Two texts that begin alike (a text and its edited form) are parsed together as
far as they agree.

Defined results: a null text is the empty text; empty texts have the empty
fingerprint, alike 1 to each other and 0 to others; equal texts have equal
fingerprints; a text of few phrases has a shorter fingerprint; ids that repeat
are followed by each other in the order of a hash of their texts, then of the
texts; a null id comes first; an empty table gives an empty table; columns besides doc_id and text are not
looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, shuffle_partitions
from tessera.llm.hashing import prefix_hash, run_hashes

K = 64
#: Digits of a hash in the fingerprint.
DIGITS = 8
#: Stands for a null id.
_FIRST = -(1 << 63)


def parse(data: bytes, at: int = 0, end: int | None = None, known: set[bytes] | None = None) -> tuple[list[int], set[bytes], bool]:
    """The ends of the phrases of data[at:end], all phrases known then, and whether the last one is new.

    The phrases known are closed under prefixes, so the longest one is found by
    stepping up or down from three bytes, where most end.
    """
    known = set() if known is None else known
    end = len(data) if end is None else end
    ends: list[int] = []
    new = False
    add, found = known.add, ends.append
    while at < end:
        stop = at + 3
        phrase = data[at:stop]
        if phrase in known:
            while phrase in known and stop < end:
                stop += 1
                phrase = data[at:stop]
        else:
            while stop > at + 1:
                shorter = data[at : stop - 1]
                if shorter in known:
                    break
                stop -= 1
                phrase = shorter
        if stop >= end:
            stop = end
            phrase = data[at:stop]
            new = phrase not in known
        add(phrase)
        found(stop)
        at = stop
    return ends, known, new


def sketch(data: bytes, ends: list[int]) -> str:
    """The K smallest hashes of the phrase set, as hexadecimal digits."""
    if not ends:
        return ""
    stops = np.array(ends)
    hashes = run_hashes(prefix_hash(np.frombuffer(data, np.uint8)), np.append(0, stops[:-1]), stops) >> np.uint64(64 - 4 * DIGITS)
    # Phrases differ but for the last one, so these hold K different hashes in all but freak cases.
    if len(hashes) > 2 * K and len(least := np.unique(np.partition(hashes, 2 * K)[: 2 * K])) >= K:
        return least[:K].astype(">u4").tobytes().hex()
    return np.unique(hashes)[:K].astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    return sketch(data, parse(data)[0])


def fingerprints(text: str, edited: str) -> tuple[str, str]:
    """The fingerprints of two texts; what they begin alike with is parsed once."""
    a, b = text.encode("utf-8", "surrogatepass"), edited.encode("utf-8", "surrogatepass")
    same = len(os.path.commonprefix([a, b])) if a[:1] == b[:1] else 0
    ends, known, new = parse(a, 0, same)
    # The last phrase may have been cut short by `same`, and would have gone on.
    at = ends[-2] if len(ends) > 1 else 0
    if new:
        known.discard(a[at:same])
    ends = ends[:-1]
    in_b = set(known)
    ends_a = parse(a, at, len(a), known)[0]
    ends_b = parse(b, at, len(b), in_b)[0]
    return sketch(a, ends + ends_a), sketch(b, ends + ends_b)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of common phrases, exact for fingerprints of fewer than K phrases, else estimated."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + DIGITS] for i in range(0, len(s), DIGITS)} for s in (a, b))
    both = sorted(x | y)
    if max(len(x), len(y)) >= K:  # beyond the K smallest of both nothing is known
        both = both[:K]
    return sum(h in x and h in y for h in both) / len(both)


def _cuts(ids: DataFrame, blocks: int) -> list[tuple[int, float]]:
    """The (id, hash) after which blocks end; an id that fills several blocks is cut by the hash of its texts."""
    found = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 10_000).alias("cuts")).first()["cuts"] or []
    times = Counter(found)
    cuts = [(v, math.inf) for v in times]
    # At most `blocks` ids are found more than once.
    for v, n in times.items():
        cuts += [(v, -(2.0**63) + 2.0**64 * k / n) for k in range(0 if n > 1 else 1, n)]
    return sorted(cuts)


def with_next(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, ahead, doc_id, text) dealt by id into sorted blocks, one a partition; each also has the next one's first row, with ahead = true.

    Only the blocks' borders and first places, one pair a block, reach the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("place"), F.xxhash64(text).alias("tie"), text.alias("text"))
    cuts = _cuts(thin.select(F.col("place").alias("doc_id")), blocks)

    @F.pandas_udf("int")
    def block_of(place: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_left(cuts, x) for x in zip(place.tolist(), tie.tolist(), strict=True)], dtype="int32")

    firsts = thin.select("place", "tie", block_of("place", "tie").alias("block")).groupBy("block").agg(F.min(F.struct("place", "tie")).alias("first")).orderBy("block").collect()
    before = {tuple(r["first"]): firsts[i - 1]["block"] for i, r in enumerate(firsts)}

    @F.pandas_udf("array<struct<block:int,ahead:boolean>>")
    def places(place: pd.Series, tie: pd.Series) -> pd.Series:
        own = ((x, [(bisect.bisect_left(cuts, x), False)]) for x in zip(place.tolist(), tie.tolist(), strict=True))
        return pd.Series([o + ([(before[x], True)] if x in before else []) for x, o in own])

    rows = thin.withColumn("to", F.explode(places("place", "tie"))).select("to.block", "to.ahead", "doc_id", "text", "place", "tie")
    dealt = rows.repartitionById(len(cuts) + 1, "block").sortWithinPartitions("ahead", "place", "tie", "text")
    return dealt.select("block", "ahead", "doc_id", "text")


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edit_and_compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come block by block in order; a text waits for the next one, its row for that one's fingerprint."""
    text_of, row, over = None, None, None
    for batch in batches:
        out = []
        for block, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if over == block:
                continue
            if text_of is not None:
                done, row = row, _edited(*text_of, text)
                if done:
                    out.append(done | {"near_next": likeness(done["fingerprint"], row["fingerprint"])})
            text_of = (doc_id, text)
            if ahead:
                if row:
                    out.append(row | {"near_next": likeness(row["fingerprint"], fingerprint(text))})
                text_of, row, over = None, None, block
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def _edited(doc_id: int | None, text: str, following: str) -> dict:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + following[:cut]
    own, changed = fingerprints(text, edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": digest, "fingerprint": own, "edited_fingerprint": changed, "near_edited": likeness(own, changed)}


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = with_next(documents(spark, sf_dir), 3 * shuffle_partitions(spark))
    return dealt.mapInArrow(_edit_and_compare, FINGERPRINTS)
