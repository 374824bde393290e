"""Packing tokenised documents into windows by the sum-of-squares rule.

Each task packs the documents of its partition as they come.  An array counts
the partially filled windows of every fill level; a piece goes where the sum
of the squares of these counts ends up smallest, be it an open window or a new
one (Csirik et al., 2006).  No level piles up, so nearly all windows are
closed full.  A document longer than a window is cut into full windows first
and its rest is placed.  What is still open in the end is poured together:
the emptiest windows are cut to fill the gaps of the fullest, so a partition
pads one window at most.

Nothing is shuffled.  A task holds one batch of texts and the open windows'
pieces, whose number the rule keeps near the number of levels.  The same
partitions give the same pieces, so a task that is run again agrees.

Defined results: a null text is the empty text; an empty text is one end
token; equal rows are packed each; a very long text is tokenised in parts cut
where no token can cross; an empty table gives an empty table; columns besides
doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

WINDOW = 2048
END_ID = 1
#: Characters that are tokenised at once; between two letters' words no token crosses the space.
PART_CHARS = 1 << 20
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

PIECES = "doc_id long, start long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def tokenizer_of(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of the byte-level BPE in path, a tokenizer file.

    Where the same vocabulary lies beside it as ranks, the ranks are used: the
    ids are the same (a test holds the two against each other), three times as fast.
    The string of an added token in a text is that token, on both ways.
    """
    ranks_file = Path(path).with_suffix(".tiktoken")
    added = json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens") or []
    plain = all(t["content"].isascii() and not (set(t["content"]) & set(" \t\r\n") or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    if ranks_file.exists() and plain:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.read_bytes().splitlines() if line)}
        special = {t["content"]: t["id"] for t in added}
        encode = tiktoken.Encoding(ranks_file.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy
        whole = lambda text: encode(text, allowed_special="all")
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(text: str) -> np.ndarray:
        parts, at = [], 0
        while plain and len(text) - at > PART_CHARS and (cut := _CUT.search(text, at + PART_CHARS)):
            parts.append(whole(text[at : cut.start()]))
            at = cut.start()
        parts.append(whole(text[at:] if at else text))
        return np.concatenate([*parts, [END_ID]]).astype(np.uint32)

    return ids


class SumOfSquares:
    """Places pieces of up to `window` tokens; knows the open windows only."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]  # the open windows of each level
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for a piece of that size."""
        n, full = self.count, self.window
        if size == full:
            self.made += 1
            return self.made - 1, 0
        # What n[level]**2 summed up changes by, for each level the piece may be put on.
        top = full - size
        change = 2 * (n[size + 1 : full + 1] - n[1 : top + 1]) + 2
        change[-1] = 1 - 2 * n[top]  # closes the window
        change[n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = int(np.argmin(change)) + 1
        if 2 * n[size] + 1 <= change[level - 1]:
            level = 0
        if level:
            n[level] -= 1
            which = self.open[level].pop()
        else:
            which = self.made
            self.made += 1
        if level + size < full:
            n[level + size] += 1
            self.open[level + size].append(which)
        return which, level


def pour(held: dict[int, list[tuple]], window: int) -> Iterator[tuple]:
    """Cut the pieces of the emptiest windows into the gaps of the fullest.

    held: the open windows' pieces, (doc_id, start, ids, doc_tokens).  Yields them with window and offset.
    """
    fill = {w: sum(len(p[2]) for p in pieces) for w, pieces in held.items()}
    order = sorted(held, key=lambda w: (-fill[w], w))
    last = len(order) - 1
    for i, w in enumerate(order):
        if i > last:
            break
        pieces = held[w]
        while i < last and fill[w] < window:
            gap, source = window - fill[w], order[last]
            doc_id, start, ids, total = held[source].pop()
            if len(ids) > gap:
                held[source].append((doc_id, start, ids[: len(ids) - gap], total))
                start, ids = start + len(ids) - gap, ids[len(ids) - gap :]
            pieces.append((doc_id, start, ids, total))
            fill[w] += len(ids)
            fill[source] -= len(ids)
            if not held[source]:
                last -= 1
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, ids, total, w, offset
            offset += len(ids)


def _packer(path: str, window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, rule, held = tokenizer_of(path), SumOfSquares(window), {}
        fill: dict[int, int] = {}
        base = TaskContext.get().partitionId() << 40

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            lengths = np.array([len(p[2]) for p in pieces], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate([p[2] for p in pieces]).astype(np.int32)))
            column = lambda k, add=0: pa.array([None if p[k] is None else p[k] + add for p in pieces], pa.int64())
            return pa.RecordBatch.from_arrays([column(0), column(1), ids, column(3), column(4, base), column(5)], names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            done: list[tuple] = []
            waiting = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    which, offset = rule.place(len(piece))
                    held.setdefault(which, []).append((doc_id, start, piece, len(ids)))
                    fill[which] = offset + len(piece)
                    if fill.pop(which) == window:
                        at = 0
                        for p in held.pop(which):
                            done.append((*p, which, at))
                            at += len(p[2])
                            waiting += len(p[2])
                    if waiting > 1 << 20:
                        yield rows(done)
                        done, waiting = [], 0
            if done:
                yield rows(done)
        if rest := list(pour(held, window)):
            yield rows(rest)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its token ids."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(_packer(tokenizer_path, window), PIECES)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ids by their number and checksum."""
    for batch in batches:
        ids = batch.column(2)
        flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(3), batch.column(4), batch.column(5)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.mapInArrow(_crc, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(documents(spark, sf_dir), default_tokenizer()))
