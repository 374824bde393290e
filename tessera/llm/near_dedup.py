"""Near-duplicates by Order MinHash and banded alignment.

1. A text's words give its 5-word shingles, each labelled with how often it
   has occurred before.  For each of SKETCHES hash functions the TUPLE smallest
   labelled shingles are kept in the order they have in the text (Marcais et
   al., 2019): two texts agree in a sketch when they share these shingles and
   their order, so the sketches follow edit similarity.  As many more are of
   3-word shingles, which scattered edits leave standing; texts of SHORT words
   at most have as many of 2-word shingles, and those of TINY words at most a
   key for each way to leave out words that THRESHOLD allows: two of these that
   are alike always agree in one.
2. Texts that agree in a sketch meet in its bucket, whose first text is its
   centre.  A text is paired with the least of its buckets' centres, then once
   with each group of texts so linked that another centre of its lies in: about
   as many pairs as texts, however large the buckets.
3. Pairs are verified by aligning their words in a band as wide as a
   similarity of THRESHOLD allows: words in common, in order, over the longer
   text's words.
4. Verified pairs make components.  What then is in buckets of several
   components is compared member by member, in blocks, by bits that say which
   words a member has, and aligned where these allow it.  Buckets of over LARGE
   members, as a very common passage makes, are parted first: a member goes on
   under its rarest words, so many of them that two members that are alike must
   have one in common (a prefix filter), and only where another member has it.

Pairs of TINY words at most are all found, and of pairs that agree in a sketch
none is left out.  Longer ones can be missed where edits lie scattered and near
THRESHOLD; README has the recall measured.

Equal word sequences are collapsed before all this.  Defined results: words are
compared in lower case and without punctuation; texts without a word (null
and empty ones as well) are a class where they are identical, null counting as
empty; equal rows share a class and are kept or dropped together; a null doc_id
sorts first; a very long text is sketched in blocks; an empty table gives an
empty table; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import PART_ROWS, broadcast_if_small, documents, materialise, parts_of, salted_join, shuffle_partitions
from tessera.llm.components import components
from tessera.llm.hashing import mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
SKETCHES = 24
TUPLE = 2
#: Words up to which texts have sketches of 2-word shingles, and up to which they are found exactly.
SHORT = 64
TINY = 14
#: Members of a bucket that are compared at once, and up to which a bucket isn't parted.
BLOCK = 2000
LARGE = 20_000
#: One text in so many tells which buckets are frequent.
SEEN = 16
#: Bits of the signature that says which words a member has.
SIGNATURE = 1024

_COLUMNS = 1 << 15
#: Keep the kinds of bucket apart.
_CLOSE, _SHORT, _LEFT_OUT = np.int64(0x3C6EF372FE94F82B), np.int64(0x1F83D9ABFB41BD6B), np.uint64(0x510E527FADE682D1)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n, None], seeds[n:, None] | np.uint64(1)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles mixed with the number of equal ones before them."""
    order = np.argsort(shingles, kind="stable")
    inorder = shingles[order]
    new = np.append(True, inorder[1:] != inorder[:-1])
    if new.all():
        return shingles
    at = np.arange(len(order))
    earlier = np.empty(len(order), np.uint64)
    earlier[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(earlier > 0, mix(shingles + earlier * np.uint64(0xD6E8FEB86659FD93)), shingles)


def order_sketches(words: np.ndarray, shingle: int = SHINGLE, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """One 64-bit value per sketch; none for a text without words."""
    if not len(words):
        return np.zeros(0, np.int64)
    label = labelled(shingle_hashes(words, shingle))
    flip, times = _seeds(sketches)
    row = np.arange(sketches)
    best = np.zeros((sketches, 0), np.int64)
    for start in range(0, len(label), _COLUMNS):
        part = label[start : start + _COLUMNS]
        # What was least so far is looked at again in front of the block.
        value = np.concatenate([(label[best] ^ flip) * times, (part ^ flip) * times], axis=1) if start else (part ^ flip) * times
        least = []
        for _ in range(min(size, value.shape[1])):
            least.append(value.argmin(axis=1))
            value[row, least[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at, held = np.stack(least, axis=1), best.shape[1]
        best = np.where(at < held, np.take_along_axis(best, np.minimum(at, max(0, held - 1)), axis=1), at - held + start) if held else at + start
    best.sort(axis=1)
    value = np.arange(sketches, dtype=np.uint64)
    for i in range(best.shape[1]):
        value = mix(value * np.uint64(0x100000001B3) + label[best[:, i]])
    return value.view(np.int64)


def left_out(words: np.ndarray) -> np.ndarray:
    """A value for each sequence that is left of a text's words when as many are left out as THRESHOLD allows, or fewer."""
    n, found = len(words), []
    for size in range(int(np.ceil(THRESHOLD * n)), n + 1):
        value = np.zeros(1, np.uint64)
        for place in np.array(list(combinations(range(n), size))).T:
            value = value * np.uint64(0x100000001B3) + words[place]
        found.append(mix(value) ^ _LEFT_OUT)
    return np.unique(np.concatenate(found)).view(np.int64)


def bucket_keys(words: np.ndarray) -> np.ndarray:
    """The buckets of a text: all its sketches, and for a tiny one what is left when words are left out."""
    if not len(words):
        return np.zeros(0, np.int64)
    keys = [order_sketches(words), order_sketches(words, 3) ^ _CLOSE]
    if len(words) <= SHORT:
        keys.append(order_sketches(words, 2) ^ _SHORT)
    if len(words) <= TINY:
        keys.append(left_out(words))
    return np.concatenate(keys)


def content_key(text: str, words: np.ndarray) -> bytes:
    """Equal for texts with equal words; for texts without words, for identical ones."""
    return hashlib.blake2b(words.tobytes() if len(words) else b"-" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, values = [], [], []
        for text in batch.column(2).to_pylist():
            words = word_hashes(text or "")
            keys.append(content_key(text or "", words))
            counts.append(len(words))
            values.append(bucket_keys(words))
        sketches = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)), pa.array(np.concatenate(values)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), sketches], names=["doc_id", "row_key", "content", "n_words", "sketch"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, words = [], []
        for text in batch.column(0).to_pylist():
            w = word_hashes(text or "")
            keys.append(content_key(text or "", w))
            words.append((w >> np.uint64(32)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.binary())], names=["content", "words"])


def banded_common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence whose pairs of places differ by band at most.

    Rows of the alignment are bit vectors over the band (Hyyro, 2004), moved
    along block by block, so that memory follows the band and not the texts.
    """
    n, common, low = len(a), 0, 0
    step = max(256, band)
    vector = 0  # bits of places below `top` that are 0 count as matched; above it all are 1
    top = 0
    for start in range(0, len(b), step):
        stop = min(len(b), start + step)
        keep, reach = max(0, start - band), min(n, stop + band)
        if keep > low:  # places that the band has left behind
            gone = min(keep, top) - low
            if gone > 0:
                common += gone - (vector & ((1 << gone) - 1)).bit_count()
                vector >>= gone
            low = keep
            top = max(top, low)
        if low >= n:
            break
        vector |= ((1 << (reach - top)) - 1) << (top - low) if reach > top else 0
        top = max(top, reach)
        full = (1 << (top - low)) - 1
        place: dict[int, int] = {}
        for i, word in enumerate(a[low:top].tolist()):
            place[word] = place.get(word, 0) | 1 << i
        inside = (1 << (2 * band + 1)) - 1
        for j, word in enumerate(b[start:stop].tolist(), start):
            hit = place.get(word)
            if hit is None:
                continue
            shift = j - band - low
            hit &= (inside << shift) if shift >= 0 else (inside >> -shift)
            both = vector & hit
            if both:
                vector = ((vector + both) | (vector - both)) & full
    return common + (top - low) - vector.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Words in common, in order, over the longer text's; 0 where it can't reach threshold."""
    longer = max(len(a), len(b))
    need = threshold * longer
    if min(len(a), len(b)) < need:
        return 0.0
    x, y = np.sort(a), np.sort(b)
    values, at, count = np.unique(x, return_index=True, return_counts=True)
    other = np.searchsorted(y, values, "right") - np.searchsorted(y, values, "left")
    if np.minimum(count, other).sum() < need:
        return 0.0
    return banded_common(a, b, longer - int(np.ceil(need)) + 1) / longer


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alike = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], names=["a", "b", "similarity"])
        yield found.filter(pa.array([s >= THRESHOLD for s in alike]))


def signatures(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the bits of its words' hashes, and how many words the bits don't count."""
    slot = [np.unique(w & np.uint32(SIGNATURE - 1)) for w in words]
    bits = np.zeros((len(words), SIGNATURE), np.uint8)
    bits[np.repeat(np.arange(len(words)), [len(s) for s in slot]), np.concatenate(slot)] = 1
    return np.packbits(bits, axis=1).view(np.uint64), np.array([len(w) - len(s) for w, s in zip(words, slot, strict=True)])


def compare(members: list[tuple], key: int, within: bool, left: int) -> Iterator[tuple[int, int, float]]:
    """The links between members (node, root, keys, words) of different components: of all, or of the first `left` with the others.

    Bits in common and the words that bits don't count are at least as many as
    common words.  Two members are aligned in the first of their keys alone, and
    a link joins two components for the rest of the block.
    """
    words = [np.frombuffer(m[3], np.uint32) for m in members]
    size, root = np.array([len(w) for w in words]), np.array([m[1] for m in members])
    bits, more = signatures(words)
    earlier = [{x for x in m[2] if x < key} for m in members]
    for k in range(left if not within else len(members)):
        low = k + 1 if within else left
        need = THRESHOLD * np.maximum(size[low:], size[k])
        fit = np.flatnonzero((root[low:] != root[k]) & (np.minimum(size[low:], size[k]) >= need))
        if len(fit):
            common = np.bitwise_count(bits[low + fit] & bits[k]).sum(axis=1) + np.minimum(more[low + fit], more[k])
            for m in (low + fit[common >= need[fit]]).tolist():
                if root[m] != root[k] and earlier[k].isdisjoint(earlier[m]) and (alike := similarity(words[k], words[m])) >= THRESHOLD:
                    yield members[k][0], members[m][0], alike
                    root[root == root[m]] = root[k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come group by group (key, i, j), the block i of each first."""
    members: list[tuple] = []
    group, left = None, 0

    def links() -> Iterator[pa.RecordBatch]:
        found = list(compare(members, group[0], group[1] == group[2], left)) if len(members) > 1 else []
        if found:
            yield pa.RecordBatch.from_pydict({"a": [f[0] for f in found], "b": [f[1] for f in found], "similarity": [f[2] for f in found]})

    for batch in batches:
        for key, i, j, block, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, i, j) != group:
                yield from links()
                members, group, left = [], (key, i, j), 0
            members.append(tuple(member))
            left += block == i
    yield from links()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's words, equal ones told apart, and how many of the rarest must hold one that it shares with any like it."""
    for batch in batches:
        terms = [labelled(mix(np.frombuffer(w, np.uint32).astype(np.uint64))).view(np.int64) for w in batch.column(2).to_pylist()]
        size = np.array([len(t) for t in terms], np.int64)
        first = size - np.ceil(THRESHOLD * size - 1e-9).astype(np.int64) + 1
        row = pa.array(np.repeat(np.arange(len(terms)), size))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate([np.zeros(0, np.int64), *terms])), pa.array(np.repeat(size, size)), pa.array(np.repeat(first, size))],
            names=["bucket", "node", "term", "size", "first"],
        )


def _parted(large: DataFrame, words: DataFrame) -> DataFrame:
    """(key, node) instead of (bucket, node) for large buckets: under the rarest words of each member."""
    terms = materialise(large.join(words, "node").select("bucket", "node", "words").mapInArrow(_terms, "bucket long, node long, term long, size long, first long"), "terms")
    often = materialise(terms.groupBy("bucket", "term").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = salted_join(terms, often.withColumnRenamed("n", "times"), ["bucket", "term"], "node", often)
    own = W.partitionBy("bucket", "node")
    placed = shared.withColumn("place", F.row_number().over(own.orderBy("times", "term"))).withColumn("alone", F.col("size") - F.count("*").over(own))
    return placed.where(F.col("place") <= F.col("first") - F.col("alone")).select(F.xxhash64("bucket", "term").alias("key"), "node")


def _links_within(buckets: DataFrame, roots: DataFrame, texts: DataFrame, thin: DataFrame) -> DataFrame | None:
    """Links between members of buckets that hold several components; None where there is no such bucket."""
    placed = buckets.select("bucket", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = materialise(placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y"), "apart")
    left = materialise(salted_join(placed, split.select("bucket"), "bucket", "node", split).select("bucket", "node", "root", "n"), "split")
    if left.isEmpty():
        return None
    words = _words_of(left.select("node").distinct(), texts, thin)
    keys = left.where(F.col("n") <= LARGE).select(F.col("bucket").alias("key"), "node")
    large = left.where(F.col("n") > LARGE)
    if not large.isEmpty():
        keys = keys.unionByName(_parted(large.select("bucket", "node"), words))
    keys = materialise(keys.join(left.select("node", "root").distinct(), "node"), "keys")
    met = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    met = materialise(met.select("key", "members", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "met")
    held = salted_join(keys, met.drop("members"), "key", "node", met.withColumnRenamed("members", "n"))
    held = materialise(held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "held")
    own = held.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("own"))
    wide = held.join(own, "node").join(words, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "own", "words")
    dealt = wide.repartition(3 * shuffle_partitions(buckets.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "node")
    return materialise(dealt.mapInArrow(_compare, "a long, b long, similarity double"), "links")


def bucket_members(member: DataFrame) -> DataFrame:
    """(bucket, node, n_words, n, centre, n_centre) of the buckets with several of the members (node, n_words, bucket), which are shuffled once.

    Members of frequent buckets are dealt to parts, whose numbers and centres are
    put together afterwards.  Which these are is told by the members of one node
    in SEEN: that decides where rows go, and nothing else.
    """
    seen = materialise(member.where(F.pmod(F.xxhash64("node"), F.lit(SEEN)) == 0).groupBy("bucket").agg(F.count("*").alias("n")), "seen")
    parts = parts_of(F.col("bucket"), seen, max(1, PART_ROWS // SEEN))
    parts = F.lit(1) if parts is None else parts
    own = W.partitionBy("bucket", "salt")
    dealt = member.withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")))
    counted = dealt.select("bucket", "node", "n_words", "parts", F.count("*").over(own).alias("n"), F.min(F.struct("node", "n_words")).over(own).alias("c"))
    counted = materialise(counted.where("n > 1 or parts > 1"), "buckets")
    whole = materialise(counted.where("parts > 1").groupBy("bucket").agg(F.count("*").alias("of_all"), F.min("c").alias("least")), "whole")  # fewer than PARTS
    put = counted.join(F.broadcast(whole), "bucket", "left").withColumn("n", F.coalesce("of_all", "n")).withColumn("c", F.coalesce("least", "c")).where("n > 1")
    return put.select("bucket", "node", "n_words", "n", F.col("c.node").alias("centre"), F.col("c.n_words").alias("n_centre"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, row_key (xxhash64 of the text), n_words, class_id, class_size, kept."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    rows = materialise(thin.mapInArrow(_sketch, "doc_id long, row_key long, content binary, n_words int, sketch array<long>"), "sketches")
    # One node for all rows with the same words.
    texts = rows.groupBy("content").agg(F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "row_key")).alias("of"), F.count("*").alias("n"))
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    buckets = bucket_members(texts.select("node", "n_words", F.explode("sketch").alias("bucket")))
    roots = None
    if not buckets.isEmpty():
        # One pair a node first: with the least centre of all its buckets.
        fit = F.least("n_words", "n_centre") >= THRESHOLD * F.greatest("n_words", "n_centre")
        pairs = buckets.where((F.col("node") != F.col("centre")) & fit)
        links = _verified(pairs.groupBy("node").agg(F.min("centre").alias("a")).select("a", F.col("node").alias("b")), texts, thin)
        # Then with the centres in other groups, once for each of these.  A group is what two links lead to.
        up = links.select(F.col("b").alias("node"), F.col("a").alias("group"))
        up = up.join(up.select(F.col("node").alias("group"), F.col("group").alias("top")), "group", "left").select("node", F.coalesce("top", "group").alias("group"))
        up = materialise(up, "groups")
        apart = pairs.select("node", "centre").distinct().join(up, "node", "left").join(up.select(F.col("node").alias("centre"), F.col("group").alias("other")), "centre", "left")
        apart = apart.select("node", "centre", F.coalesce("group", "node").alias("group"), F.coalesce("other", "centre").alias("other")).where("`group` <> other")
        more = _verified(apart.groupBy("node", "other").agg(F.min("centre").alias("a")).select("a", F.col("node").alias("b")), texts, thin)
        roots = materialise(components(links.unionByName(more)), "roots")
        found = _links_within(buckets, roots, texts, thin)
        if found is not None and not found.isEmpty():
            root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            joined = found.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
            above = materialise(components(joined), "roots").select(F.col("node").alias("root"), F.col("root").alias("top"))
            alone = above.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
            roots = materialise(roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone), "roots")

    placed = texts.select("content", "node", "of", "n")
    placed = placed.withColumn("root", F.col("node")) if roots is None else placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.drop("node")
    classes = materialise(placed.groupBy("root").agg(F.min("of").alias("keep"), F.sum("n").alias("class_size"), F.count("*").alias("n")), "classes")
    each = salted_join(placed.select("content", "root"), classes.drop("n"), "root", "content", classes).drop("root")
    member = salted_join(rows.select("doc_id", "row_key", "n_words", "content"), each, "content", "doc_id", texts)
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("row_key") == F.col("keep.row_key"))
    return member.select("doc_id", "row_key", F.col("n_words").cast("long").alias("n_words"), F.col("keep.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def _words_of(nodes: DataFrame, texts: DataFrame, thin: DataFrame) -> DataFrame:
    """(node, words) of the nodes given, from a second reading of their texts."""
    wanted = materialise(texts.join(nodes, "node").select("node", "content", F.col("of.doc_id").alias("wanted")), "wanted")
    ids = broadcast_if_small(wanted.select("wanted").distinct(), 16)
    words = thin.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text").mapInArrow(_words, "content binary, words binary")
    return materialise(words.join(wanted, "content").groupBy("node").agg(F.first("words").alias("words")), "words")


def _verified(pairs: DataFrame, texts: DataFrame, thin: DataFrame) -> DataFrame:
    """The pairs (a, b) that alignment confirms, written down."""
    pairs = materialise(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.withColumn("similarity", F.lit(1.0))
    words = _words_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, thin)
    both = salted_join(pairs, words.select(F.col("node").alias("a"), F.col("words").alias("x")), "a", "b")
    both = both.join(words.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return materialise(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long, similarity double"), "links")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept", "n_words")
