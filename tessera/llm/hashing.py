"""Hashes of byte and word runs, for whole batches of text at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
#: BASE * INVERSE == 1 modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of BASE, or of INVERSE.

    Not kept in a cache: a cached function is pickled by its name, and would be
    looked for on executors that have no copy of this package.
    """
    out = np.full(max(1, n), INVERSE if inverse else BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """prefix[i]: the sum of (byte + 1) * BASE**place over the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the runs [start, end): equal runs have equal hashes wherever they are."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start] + (end - start).astype(np.uint64))


_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz_")] = True
_WORD[128:] = True


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-case UTF-8 bytes start and end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = word_edges(data)
    return run_hashes(prefix_hash(data), start, end), start, end


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word: runs of ASCII letters, digits and any other non-ASCII characters, in lower case."""
    return _words(np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8))[0]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a UTF-8 text; only ASCII letters are lowered, so places stay."""
    return _words(np.frombuffer(raw.lower(), np.uint8))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; a shorter text is one run."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + words[i : len(words) - k + 1 + i]
    return mix(out)
