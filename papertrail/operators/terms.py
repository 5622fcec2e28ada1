"""Terms of a dictionary in messages: equi-joins on what a message's words share with terms, however many terms there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.functions.text import damerau, normalize_query, osa

#: The longest term, in words; longer ones are not looked up.
MOST_WORDS = 8
_NOT_LATIN = r"[^\u0000-ɏ]"


def _one_less(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def neighbourhood(word: Column, slips: Column) -> Column:
    """What is left of a (non-empty) word when up to `slips` characters go, 2 at most. Two words that are n edits apart,
    swapped neighbours counting one, have a string in common that is n deletions away from each."""
    one = _one_less(word)
    two = F.flatten(F.transform(F.filter(one, lambda w: F.length(w) > 0), _one_less))
    own = F.array(word)
    return F.when(slips >= 2, F.array_distinct(F.concat(own, one, two))).when(slips == 1, F.array_distinct(F.concat(own, one))).otherwise(own)


def allowed_slips(term: Column) -> Column:
    """How many slips a single Latin word may have and still be this term: two from eight letters on, one from five."""
    plain = ~term.rlike(_NOT_LATIN) & ~F.contains(term, F.lit(" "))
    return F.when(plain & (F.length(term) >= 8), 2).when(plain & (F.length(term) >= 5), 1).otherwise(0)


def close_terms(words: DataFrame, terms: DataFrame, *, between: bool = False) -> DataFrame:
    """(word, term, distance) for words (word) and terms (term, slips): the pairs that are at most `slips` edits apart.

    Both sides are filed under their deletion neighbourhoods and meet by equality; only pairs that meet are measured.
    Each distinct word is looked up once. Words are taken as they are. Swapped neighbours count one edit; with `between`
    also if letters have come between them or gone (see damerau_distance), which meet by the same neighbourhoods.
    """
    asked = words.select("word").filter(F.length("word") > 0).distinct().select("word", F.explode(neighbourhood(F.col("word"), F.when(F.length("word") >= 6, 2).otherwise(1))).alias("part"))
    filed = terms.select("term", "slips").filter("slips > 0").distinct().select("term", "slips", F.explode(neighbourhood(F.col("term"), F.col("slips"))).alias("part"))
    met = asked.join(filed, "part").filter(F.abs(F.length("word") - F.length("term")) <= F.col("slips")).select("word", "term", "slips").distinct()
    return met.withColumn("distance", (damerau if between else osa)(2)(F.col("word"), F.col("term"))).filter(F.col("distance") <= F.col("slips")).select("word", "term", "distance")


def word_places(messages: DataFrame, *, by: str = "message_id") -> DataFrame:
    """(message, pos, word, start): the words of a normalised text (blanks part them) with their places."""
    words = messages.select(by, F.posexplode(F.split("text", " ")).alias("pos", "word")).filter("word <> ''")
    before = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("start", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("int"))


def mentions(messages: DataFrame, terms: DataFrame, *, by: str = "message_id", most_words: int | None = None) -> DataFrame:
    """(message, key, term, start, end, fuzzy): where terms (key, term, slips) stand in normalised messages (message, text).

    A term begins where a word begins. Latin terms also end with one; in other scripts the last word may go on, as
    endings do. Single words, with or without a final s, may have the term's slips; such hits are fuzzy and end with the
    word. Runs of words are looked up as wholes, by equality; the terms' longest decides how long runs get, up to eight.
    """
    if most_words is None:
        most_words = min(MOST_WORDS, terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1)
    places = word_places(messages, by=by)
    order = Window.partitionBy(by).orderBy("pos")
    ahead = places.select(by, "start", *(F.lead("word", n).over(order).alias(f"w{n}") for n in range(most_words)))
    later = [F.col(f"w{n}") for n in range(most_words)]
    runs = [F.when(later[n].isNotNull(), F.struct(F.concat_ws(" ", *later[: n + 1]).alias("run"), F.length(later[n]).alias("tail"))) for n in range(most_words)]
    runs = ahead.select(by, "start", F.explode(F.array_compact(F.array(*runs))).alias("r")).select(by, "start", "r.run", "r.tail")
    vocabulary = runs.select("run", "tail").distinct()
    beginnings = F.transform(F.sequence(F.length("run") - F.col("tail") + 1, F.length("run")), lambda n: F.substring("run", F.lit(1), n))
    said = F.when(F.col("run").rlike(_NOT_LATIN), beginnings).otherwise(F.array("run"))
    known = terms.select("key", "term", F.col("term").rlike(_NOT_LATIN).alias("goes_on")).filter("term <> ''")
    whole = vocabulary.select("run", F.explode(said).alias("term")).join(known, "term").filter(F.col("goes_on") | (F.col("run") == F.col("term"))).select("run", "key", "term")
    exact = runs.select(by, "start", "run").join(whole, "run").select(by, "key", "term", "start", (F.col("start") + F.length("term")).alias("end"), F.lit(False).alias("fuzzy"))
    bare = F.regexp_replace("word", "s$", "")
    latin = places.filter(~F.col("word").rlike(_NOT_LATIN)).select(by, "word", bare.alias("bare"), "start")
    close = close_terms(latin.select(F.col("bare").alias("word")), terms).join(terms.select("key", "term"), "term").select(F.col("word").alias("bare"), "key", "term")
    slipped = latin.join(close, "bare").filter(F.col("word") != F.col("term")).select(by, "key", "term", "start", (F.col("start") + F.length("word")).alias("end"), F.lit(True).alias("fuzzy"))
    return exact.unionByName(slipped).distinct()


def places_in(messages: DataFrame, places: DataFrame, *, by: str = "message_id", text: str = "text") -> DataFrame:
    """(message, place): the longest place (name) that a message names; ties by name. Names of four letters or more; single
    words of six or more may have one slip. Any number of places: nothing is sent to all workers."""
    names = places.select("name").filter("name is not null").distinct().select(F.col("name").alias("key"), normalize_query("name").alias("term"))
    single = ~F.contains(F.col("term"), F.lit(" ")) & (F.length("term") >= 6)
    names = names.filter(F.length("term") >= 4).withColumn("slips", F.when(single, 1).otherwise(0))
    found = mentions(messages.select(by, normalize_query(text).alias("text")), names, by=by)
    return found.groupBy(by).agg(F.min_by("key", F.struct(-F.length("key"), "key")).alias("place"))
