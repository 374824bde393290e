"""Golomb-Rice coding of sorted integers, vectorised.

Sorted distinct values of a known range are sent as their gaps: the high
part of each gap in unary, the low k bits as they are.  With k near
log2(range / n) a value costs about k + 1.5 bits.
"""

from __future__ import annotations

import numpy as np

_HEAD = 12  # bytes: count (8), k (1), padding to keep the unary length (3)


def rice_parameter(n: int, span: int) -> int:
    return int(max(0, np.floor(np.log2(max(1.0, span / max(1, n) * 0.69))))) if n else 0


def encode(values: np.ndarray, span: int) -> bytes:
    """values: sorted distinct unsigned integers below span."""
    n = len(values)
    k = rice_parameter(n, span)
    if not n:
        return n.to_bytes(8, "little") + bytes([k, 0, 0, 0]) + bytes(8)
    v = values.astype(np.uint64)
    gaps = np.diff(v, prepend=np.uint64(0))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1) - 1  # the place of each unary stop bit
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    packed = np.packbits(unary)
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    return n.to_bytes(8, "little") + bytes([k, 0, 0, 0]) + len(packed).to_bytes(8, "little") + packed.tobytes() + np.packbits(low).tobytes()


def decode(blob: bytes) -> np.ndarray:
    n, k = int.from_bytes(blob[:8], "little"), blob[8]
    if not n:
        return np.zeros(0, np.uint64)
    start = _HEAD + 8
    width = int.from_bytes(blob[_HEAD:start], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, width, start)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=start + width))[: n * k].reshape(n, k)
        for i in range(k):
            gaps |= bits[:, i].astype(np.uint64) << np.uint64(i)
    return np.cumsum(gaps)


def pack_by_owner(values: np.ndarray, bits: int, owners: int) -> list[tuple[int, int, int, bytes]]:
    """(owner, from, to, blob) for each owner that a slice of the sorted values falls to.

    Owner o has the values v with v * owners >> bits == o.
    """
    if not len(values):
        return []
    owner = owner_of(values, bits, owners)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
        o = int(owner[a])
        low = -((-o << bits) // owners)
        span = -((-(o + 1) << bits) // owners) - low
        out.append((o, int(a), int(b), low.to_bytes(8, "little") + encode(values[a:b] - np.uint64(low), span)))
    return out


def owner_of(values: np.ndarray, bits: int, owners: int) -> np.ndarray:
    return ((values * np.uint64(owners)) >> np.uint64(bits)).astype(np.int64)


def unpack(blob: bytes) -> np.ndarray:
    return decode(blob[8:]) + np.uint64(int.from_bytes(blob[:8], "little"))


def values_of_many(sent: list[np.ndarray], times: int) -> np.ndarray:
    """The values that at least so many senders of distinct values have, sorted."""
    every, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sent]), return_counts=True)
    return every[count >= times]


def bitmap(values: np.ndarray, among: np.ndarray) -> bytes:
    """Which of the values are among others, which are sorted."""
    at = np.searchsorted(among, values)
    hit = (among[np.minimum(at, len(among) - 1)] == values) if len(among) else np.zeros(len(values), bool)
    return np.packbits(hit).tobytes()


def repeated_bitmaps(sent: list[np.ndarray]) -> list[bytes]:
    """For each sender's distinct values a bitmap of those that another sender has too."""
    twice = values_of_many(sent, 2)
    return [bitmap(v, twice) for v in sent]
