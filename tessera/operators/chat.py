"""Conversations: context, languages of messages, the language of a reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import without_quotes, words

# Function words by which a message's language is told, and the limits of telling it.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu den im auf für dem des auch sich es sie wir ich aber wie nach bei aus noch nur".split(),
    "en": "the and of to is in that it for was with as this be on are by not or from at but they have which you an we had were".split(),
    "es": "el la los las que en un una por con para del se es al de lo como más pero sus su le ya este fue ha muy sin sobre".split(),
    "fr": "le la les des et est dans que pour un une du qui sur pas de en il elle ce au aux par avec plus ne se sont mais nous".split(),
}
LEAST_LETTERS = 10
LEAST_SURE, LEAST_WEAK = 0.6, 0.5
#: A message is surely of a language if a tenth of its words are its function words.
SURE_SHARE = 0.1
NEAR, RECENT = 2, 3
DEFAULT = "en"


def language(words: Column) -> Column:
    """struct(lang, share): the language that most of an array of words are function words of, ties by name; null with none.

    The words are looked through once a language, so let them be a column that is made before.
    """
    shares = [F.struct((F.size(F.filter(words, lambda x: x.isin(stop))) / F.greatest(F.size(words), F.lit(1))).alias("share"), F.lit(-i).alias("order"), F.lit(name).alias("lang")) for i, (name, stop) in enumerate(sorted(FUNCTION_WORDS.items()))]
    top = F.greatest(*shares)
    return F.struct(F.when(top["share"] > 0, top["lang"]).alias("lang"), F.round(top["share"], 6).alias("share"))


def message_languages(messages: DataFrame, quotes: bool = False) -> DataFrame:
    """conv_id, turn, role, lang, share, prob and whether the language is sure; quotations and references count only where `quotes` says so."""
    own = F.coalesce("text", F.lit(""))
    cut = messages.select("conv_id", "turn", "role", F.regexp_count(own, F.lit(r"\p{L}")).alias("letters"), (own if quotes else without_quotes(own)).alias("plain"))
    cut = cut.withColumn("words", words(F.col("plain")))
    found = cut.withColumn("l", language(F.col("words")))
    prob = F.round(F.least(F.lit(1.0), F.col("l.share") * (LEAST_SURE / SURE_SHARE)), 6)
    sure = F.col("l.lang").isNotNull() & (F.col("letters") >= LEAST_LETTERS) & (prob >= LEAST_SURE)
    return found.select("conv_id", "turn", "role", "l.lang", "l.share", prob.alias("prob"), sure.alias("sure"))


def last_user_turn(messages: DataFrame) -> DataFrame:
    own = messages.where("role = 'user'")
    return own.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")


def context_tail(messages: DataFrame, last: int = 8) -> DataFrame:
    """The last messages of each conversation as one text, in order, each after its role."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tail = messages.where("role <> 'system'").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= last)
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    both = tail.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return both.select("conv_id", F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def context_until_target(messages: DataFrame) -> DataFrame:
    """Messages up to the last one of the user."""
    target = last_user_turn(messages).select("conv_id", F.col("turn").alias("target"))
    return messages.join(target, "conv_id").where("turn <= target").groupBy("conv_id", "target").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def dominant_language(languages: DataFrame) -> DataFrame:
    """The commonest sure language of a conversation's user; of equals the latest."""
    per = languages.where("sure and role = 'user'").groupBy("conv_id", "lang").agg(F.count("*").alias("n"), F.max("turn").alias("latest"))
    return per.groupBy("conv_id").agg(F.max_by("lang", F.struct("n", "latest")).alias("dominant"))


def _own(languages: DataFrame) -> DataFrame:
    """The user's messages with their number from 1 in the conversation."""
    return languages.where("role = 'user'").withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))


def nearby_language(languages: DataFrame) -> DataFrame:
    """For each message of the user the sure language of the nearest other one of the user's, NEAR messages away at most, the earlier of equals."""
    own = _own(languages)
    near = own.where("sure").select("conv_id", F.explode(F.sequence(F.col("pos") - NEAR, F.col("pos") + NEAR)).alias("pos"), F.col("pos").alias("from"), F.col("lang").alias("near"))
    near = near.where("pos <> `from`").groupBy("conv_id", "pos").agg(F.min_by("near", F.struct(F.abs(F.col("pos") - F.col("from")), F.col("from"))).alias("near"))
    return own.select("conv_id", "turn", "pos").join(near, ["conv_id", "pos"]).select("conv_id", "turn", "near")


def recent_language(languages: DataFrame, last: int = RECENT) -> DataFrame:
    """(conv_id, recent, latest): the commonest language of the user's `last` sure messages, of equals the latest, and the language of the very last."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tail = languages.where("sure and role = 'user'").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= last)
    per = tail.groupBy("conv_id", "lang").agg(F.count("*").alias("n"), F.max("turn").alias("turn"))
    return per.groupBy("conv_id").agg(F.max_by("lang", F.struct("n", "turn")).alias("recent"), F.max_by("lang", "turn").alias("latest"))


def code(lang: Column) -> Column:
    """The first part of a language tag, three letters at most; null for an empty one."""
    return F.nullif(F.substring(F.split(F.replace(F.lower(F.trim(lang)), F.lit("_"), F.lit("-")), "-")[0], 1, 3), F.lit(""))


def reply_language(languages: DataFrame, known: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, lang, source): the language to reply in, the first that is known of these.

    target_message: of the message that is answered, if sure; that is the one in
    targets (conv_id, turn), or without targets the user's last one, or the last
    of all.  nearby_message: with targets, of the user's nearest messages.
    recent_messages: with targets, of the user's latest sure message, else the
    commonest of the last RECENT.  conversation, profile: as given in known
    (conv_id, conversation, profile).  target_message_weak: of the answered
    message, though not sure.  default.  A target that isn't the user's message
    is invalid_target without a language.
    """
    if targets is None:
        mine = F.struct((F.col("role") == "user").cast("int"), F.col("turn"))
        target = languages.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "lang", "sure", "prob"), mine).alias("t")).select("conv_id", "t.*")
    else:
        target = targets.select("conv_id", "turn").join(languages.select("conv_id", "turn", "role", "lang", "sure", "prob"), ["conv_id", "turn"], "left")
    got = target.join(recent_language(languages), "conv_id", "left")
    got = got.join(nearby_language(languages), ["conv_id", "turn"], "left") if targets is not None else got.withColumn("near", F.lit(None).cast("string"))
    got = got.join(known, "conv_id", "left") if known is not None else got.withColumn("conversation", F.lit(None).cast("string")).withColumn("profile", F.lit(None).cast("string"))
    step = lambda value, source, when=None: F.when(value.isNotNull() & (F.lit(True) if when is None else when), F.struct(value.alias("lang"), F.lit(source).alias("source")))
    chain = F.coalesce(
        F.when(~F.coalesce(F.col("role") == "user", F.lit(False)), F.struct(F.lit(None).cast("string").alias("lang"), F.lit("invalid_target").alias("source"))) if targets is not None else F.lit(None),
        step(F.col("lang"), "target_message", F.col("sure")),
        step(F.col("near"), "nearby_message"),
        step(F.col("recent" if targets is None else "latest"), "recent_messages"),
        step(code(F.col("conversation")), "conversation"),
        step(code(F.col("profile")), "profile"),
        step(F.col("lang"), "target_message_weak", F.col("prob") >= LEAST_WEAK),
        F.struct(F.lit(DEFAULT).alias("lang"), F.lit("default").alias("source")),
    )
    return got.select("conv_id", "turn", chain.alias("c")).select("conv_id", "turn", "c.lang", "c.source")
