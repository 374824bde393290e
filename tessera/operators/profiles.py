"""The language of texts by rank-order profiles of letter n-grams, learned from texts whose language is known.

A profile is a language's commonest n-grams in order (Cavnar and Trenkle, 1994).
A text is compared by how far its own n-grams are out of place in each profile;
the distances become probabilities.  Profiles are a table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.functions.text import once, without_quotes
from tessera.sources import broadcast_if_small, written

# Labels that stand for another, groups of close languages, and English words with their limits.
FOLD = {"arz": "ar", "ary": "ar", "acm": "ar", "apc": "ar", "ajp": "ar", "pnb": "ur"}
GROUPS = [["id", "ms"], ["ur", "fa", "pnb"], ["ar", "arz", "ary", "acm", "apc", "ajp"]]
ENGLISH = (
    "the is are was were do does did why what how who can could would should will i you he she "
    "we they it this that my your of to in on and or not a an be have has with for about islam "
    "muslims muslim god allah quran prophet"
).split()
LEAST_LATIN, LEAST_ENGLISH, LEAST_WORDS = 0.6, 0.3, 2
LEAST_SURE = 0.6
TOP = 5
DEFAULT = "en"

ORDERS = (1, 2, 3)
#: N-grams of a profile.
SIZE = 300
_NEAR = pa.list_(pa.struct([("lang", pa.string()), ("saved", pa.int64())]))
#: How sharply probabilities fall off with distance, which is from 0 to 1.
SHARPNESS = 60.0
#: Longer words are cut: only their beginning is looked at.
LONGEST_WORD = 40


def letters(text: Column) -> Column:
    """The words of a text, runs of letters in lower case with a mark at both ends."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.transform(found, lambda w: F.concat(F.lit("_"), F.substring(w, 1, LONGEST_WORD), F.lit("_")))


def grams(word: Column) -> Column:
    """All n-grams of a marked word but the mark alone."""
    of = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)))
    return F.filter(F.flatten(F.array_compact(F.array(*[of(n) for n in ORDERS]))), lambda g: g != "_")


def _ranked(words: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, gram, rank): the commonest n-grams of words (by, word, n), equally common ones by name."""
    counted = words.select(*by, "n", F.explode(grams(F.col("word"))).alias("gram")).groupBy(*by, "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*by).orderBy(F.col("n").desc(), "gram")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).drop("n")


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, rank): the profile of each language of rows, from different words with their numbers; rows without a label don't count."""
    words = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(letters(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    return written(_ranked(words.groupBy("lang", "word").agg(F.count("*").alias("n")), ["lang"], size), "profiles")


def commonest(words: list[str], size: int) -> list[str]:
    """The commonest n-grams of a text's words, equally common ones by name."""
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for order in ORDERS:
            for i in range(len(word) - order + 1):
                counts[word[i : i + order]] += n
    counts.pop("_", None)
    return sorted(counts, key=lambda g: (-counts[g], g))[:size]


def _saved(profile: dict[str, dict[str, int]], size: int, ranked: bool):
    """How near each text comes to each profile, by its words or by its n-grams in order."""
    held: dict[str, list[tuple[str, int]]] = {}
    for lang, ranks in profile.items():
        for gram, rank in ranks.items():
            held.setdefault(gram, []).append((lang, rank))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for row in batch.column(1):
                own = row.as_py() if ranked else commonest(row.as_py(), size)
                saved = dict.fromkeys(profile, 0)
                for rank, gram in enumerate(own, 1):
                    for lang, theirs in held.get(gram, ()):
                        saved[lang] += size - min(abs(rank - theirs), size)
                sizes.append(len(own))
                found.append([{"lang": lang, "saved": n} for lang, n in saved.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, _NEAR)], names=[batch.schema.names[0], "size", "near"])

    return near


def probabilities(rows: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, lang, prob): the TOP most likely languages of each text with letters, in order; quotations don't count.

    An n-gram that a profile lacks is as far out of place as the profile is long.
    A text's n-grams are counted in its row.  Rows that share a key are one text;
    n-grams of these alone are counted by a shuffle.
    """
    listed = _listed(rows, profiles, key, text)
    return listed.select(key, F.inline("p")).select(key, "place", "lang", "prob")


def _listed(rows: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, p): the (place, lang, prob) of probabilities(), one row for each text with letters."""
    held: dict[str, dict[str, int]] = {}
    for r in profiles.orderBy("lang", "rank").collect():  # SIZE rows for each language
        held.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    own = rows.select(key, once(without_quotes(F.coalesce(F.col(text), F.lit("")))).alias("plain")).select(key, letters(F.col("plain")).alias("words"))
    schema = StructType([rows.select(key).schema[0], StructField("size", LongType()), StructField("near", ArrayType(StructType([StructField("lang", StringType()), StructField("saved", LongType())])))])
    # No n-gram is shuffled but of keys that several rows have.
    twice = written(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__key")), "twice")
    if twice.isEmpty():
        found = own.where(F.size("words") > 0).mapInArrow(_saved(held, SIZE, False), schema)
    else:
        few, same = broadcast_if_small(twice, 16), F.col(key).eqNullSafe(F.col("__key"))
        words = own.join(few, same, "left_semi").select(key, F.explode("words").alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"])
        shared = _ranked(words, [key], SIZE).groupBy(key).agg(ordered.alias("grams"))
        alone = own.join(few, same, "left_anti").where(F.size("words") > 0)
        found = alone.mapInArrow(_saved(held, SIZE, False), schema).unionByName(shared.mapInArrow(_saved(held, SIZE, True), schema))
    # A null key is equal to none: such texts are near no profile.
    near = F.transform("near", lambda x: F.struct(x["lang"].alias("lang"), F.round(F.when(F.col(key).isNull(), F.lit(0)).otherwise(x["saved"]) / (F.col("size") * SIZE), 9).alias("near")))
    found = found.select(key, once(near).alias("near"))
    found = found.select(key, "near", F.array_max(F.transform("near", lambda x: x["near"])).alias("most"))
    weights = found.select(key, once(F.transform("near", lambda x: F.struct(x["lang"].alias("lang"), F.exp(SHARPNESS * (x["near"] - F.col("most"))).alias("weight")))).alias("weights"))
    summed = weights.select(key, "weights", once(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x["weight"])).alias("total"))
    ordered = F.array_sort(F.transform("weights", lambda x: F.struct((-F.round(x["weight"] / F.col("total"), 6)).alias("less"), x["lang"].alias("lang"))))
    top = summed.select(key, once(F.slice(ordered, 1, TOP)).alias("top")).where(F.size("top") > 0)
    return top.select(key, F.transform("top", lambda x, i: F.struct((i + 1).alias("place"), x["lang"].alias("lang"), (-x["less"]).alias("prob"))).alias("p"))


def folded(lang: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FOLD.items() for x in pair])
    return F.coalesce(F.try_element_at(names, lang), lang)


def english_share(text: Column) -> Column:
    """The share of English words of a text that is mostly Latin; null where it isn't, or has too few words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    latin, all_ = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(r"\p{L}"))
    share = F.size(F.filter(words, lambda w: w.isin(ENGLISH))) / F.size(words)
    return F.when((all_ > 0) & (latin >= LEAST_LATIN * all_) & (F.size(words) >= LEAST_WORDS), share)


def detect(rows: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, prob) of every row, prob to three digits.

    Where a text that is mostly Latin has enough English words it is English, whatever
    the profiles say.  An unsure language of a group of close ones has the sum of
    those of the group among the TOP.  A text without letters is DEFAULT with 0.
    """
    listed = _listed(rows, profiles, key, text)
    found = rows.select(key, without_quotes(F.coalesce(F.col(text), F.lit(""))).alias("plain")).withColumn("english", english_share(F.col("plain"))).drop("plain").join(listed, key, "left")
    first, prob = folded(F.col("p")[0]["lang"]), F.col("p")[0]["prob"]
    english = (first != "en") & (F.col("english") >= LEAST_ENGLISH)
    of_group = F.lit(0.0)
    for group in GROUPS:
        total = F.aggregate(F.filter("p", lambda x: x["lang"].isin(group)), F.lit(0.0), lambda s, x: s + x["prob"])
        of_group = F.when(first.isin(group), total).otherwise(of_group)
    told = F.when(english, F.struct(F.lit("en").alias("lang"), F.round(F.greatest(prob, "english"), 3).alias("prob")))
    sure = F.when(F.round(prob, 3) < LEAST_SURE, F.round(F.greatest(prob, of_group), 3)).otherwise(F.round(prob, 3))
    found = found.withColumn("told", F.coalesce(told, F.when(F.col("p").isNotNull(), F.struct(first.alias("lang"), sure.alias("prob"))), F.struct(F.lit(DEFAULT).alias("lang"), F.lit(0.0).alias("prob"))))
    return found.select(key, "told.lang", "told.prob")
