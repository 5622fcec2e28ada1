"""Which branch answers a message, with which types, which documents left out, and how many shown."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papertrail import dims
from papertrail.operators import answers, search
from papertrail.operators.intents import follow_up, picked_document
from papertrail.operators.owners import place_in
from papertrail.operators.vault import owned_by, period_millis
from papertrail.storage import stored

# How many results each branch shows; the oldest are looked for among more.
FIND, QUESTION, PHOTOS, WIDE = 6, 3, 60, 50
DEFAULT_TEMPLATE = "home_loan"
#: What a search is asked for: the oldest are looked for among so many, of which a reply's documents may go.
DEPTH = WIDE + FIND
_SEARCHES = ["find", "question", "follow_up_again"]


def place_named(message: Column, places: list[str]) -> Column:
    """The place a message names, of the places that photos have: a dimension of some thousand names, sent to the workers."""

    @F.pandas_udf(StringType())
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: place_in(x or "", places))

    return found(message)


def route(messages: DataFrame) -> DataFrame:
    """messages (intent, cue, correction, place, shown, context_types) with branch, types, template, exclude_shown, limit.

    In turn: a place without a document is a photo request; a correction after a reply searches its types again without
    what was shown; a follow-up asks about, shows again or searches on; else the kind of the intent decides. When the same
    types are asked for again, what was shown is left out.
    """
    i, shown, context = F.col("intent"), F.col("shown"), F.col("context_types")
    has_context = F.coalesce(F.size(context) > 0, F.lit(False))
    plan = follow_up(F.col("cue"), i, shown, context)
    at_place = F.col("place").isNotNull() & (F.size(i["doc_types"]) == 0) & i["template"].isNull() & (i["kind"] != "reminders")
    corrects = F.col("correction") & has_context
    branch = F.when(at_place, "photos").when(corrects, "find").when(plan.isNotNull(), F.concat(F.lit("follow_up_"), plan)).otherwise(i["kind"])
    own = F.when(F.size(i["doc_types"]) > 0, i["doc_types"])
    types = F.when(corrects | plan.isNotNull(), F.coalesce(own, context)).otherwise(i["doc_types"])
    again = has_context & (F.size(F.array_intersect(i["doc_types"], context)) > 0)
    exclude = corrects | F.coalesce((plan == "again") & F.col("cue.older"), F.lit(False)) | (branch.isin("find", "question") & again)
    limit = F.when(branch == "photos", PHOTOS).when(branch == "question", QUESTION).otherwise(FIND)
    template = F.when(branch == "pack", F.coalesce(i["template"], F.lit(DEFAULT_TEMPLATE)))
    return messages.withColumns({"branch": branch, "types": types, "pack_template": template, "exclude_shown": F.coalesce(exclude, F.lit(False)), "limit": limit})


def asks(routed: DataFrame, *, by: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """What route() has planned, each different thing that is asked once: (ask, key, messages, and all that decides the
    answer), and the membership (query, key). An ask is named by its smallest message.

    What doesn't matter to a branch is left out, so that messages which differ in it only share an answer: the search
    behind it is done once for all of them.
    """
    i, branch = F.col("intent"), F.col("branch")
    searches, shows, photos = branch.isin(_SEARCHES), branch.isin("follow_up_ask", "follow_up_show"), branch == "photos"
    overview = searches & i["list_all"]
    picked = picked_document(F.col("cue"), F.col("shown"))
    pointed = F.when(picked.isNotNull(), F.array(picked)).otherwise(F.col("shown"))
    category = F.when(F.col("place").isNotNull(), F.when(i["photo_category"] != "places", i["photo_category"])).otherwise(F.coalesce(i["photo_category"], F.lit("other")))
    what = {
        "text": F.when(searches & ~overview, F.col("text")),
        "types": F.when((searches & ~overview) | (branch == "reminders"), F.col("types")),
        "excluded": F.when(searches | (branch == "reminders"), i["exclude_types"]),
        "first": F.when((searches & ~overview) | photos, i["date_from"]),
        "last": F.when((searches & ~overview) | photos, i["date_to"]),
        "order": F.when(searches & ~overview, i["order"]),
        "action": F.when((searches & ~overview) | shows, i["action"]),
        "overview": overview,
        "template": F.coalesce(F.col("pack_template"), F.when(searches, i["template"])),
        "category": F.when(photos, category),
        "place": F.when(photos, F.col("place")),
        "chat_kind": F.when(branch == "chat", F.col("chat_kind")),
        "hidden": F.when(searches & ~overview & F.col("exclude_shown"), F.transform("shown", lambda d: d["id"])),
        "pointed": F.when(shows, F.transform(pointed, lambda d: F.struct(d["id"].alias("id"), d["doc_type"].alias("doc_type")))),
        "most": F.when(searches, F.col("limit")),
    }
    plans = routed.select(by, "branch", *(c.alias(k) for k, c in what.items()))
    columns = ["branch", *what]
    member = stored(plans.withColumn("key", F.sha2(F.to_json(F.struct(*columns)), 256)), "asks")
    same = [F.first(c).alias(c) for c in columns]
    return stored(member.groupBy("key").agg(F.min(by).alias("ask"), F.count("*").alias("messages"), *same), "asked"), member.select(by, "key")


def searcher(index: DataFrame, docs: DataFrame, *, owner: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The search of documents by keywords (a stored index, see search.postings) and types, for the asks of many messages."""

    def find(wanted: DataFrame) -> DataFrame:
        asked = wanted.withColumnRenamed("ask", "query_id")
        keyword = stored(search.bm25(index, search.terms_of(asked, text=F.col("text")), k=WIDE), "keyword")
        types, out = (asked.select("query_id", F.explode(c).alias("doc_type")) for c in ("types", "excluded"))
        nothing = asked.sparkSession.createDataFrame([], "query_id long, doc_id long, rank int, score double")
        hits = search.hybrid(keyword, nothing, search.by_type(docs, types), docs, types=types, excluded_types=out, periods=asked, owner=owned_by(F.col("owner_name"), owner), limit=DEPTH)
        return hits.select(F.col("query_id").alias("ask"), "id", F.col("rank").alias("place"))

    return find


def _first(rows: DataFrame, most: Column | int, *order: Column) -> DataFrame:
    """The first rows of each ask, ranked."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(*order))).filter(F.col("rank") <= most)


def _found(wanted: DataFrame, docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hits of searches: what was shown before goes; of the fifty best the oldest come first, if they are asked for."""
    hits = find(wanted.select("ask", "text", "types", "excluded", "first", "last"))
    gone = wanted.select("ask", F.explode("hidden").alias("id"))
    hits = hits.join(gone, ["ask", "id"], "left_anti").join(wanted.select("ask", "order", "most"), "ask")
    hits = hits.join(docs.select("id", "effective_type", "effective_date"), "id")
    wide = _first(hits, F.when(F.col("order") == "oldest", WIDE).otherwise(F.col("most")), F.col("place"))
    by_age = F.when(F.col("order") == "oldest", F.col("effective_date"))
    return _first(wide, F.col("most"), by_age, F.col("place")).select("ask", "rank", F.col("id").cast("string").alias("item"), "effective_type")


def _overviews(wanted: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest documents but of types that are ruled out, and (ask, total, counts of types, the most frequent first):
    from the first few of each type and a count of each type, of which there are as many as types."""
    per_type = docs.withColumn("r", F.row_number().over(Window.partitionBy("effective_type").orderBy(F.desc("effective_date"), "id")))
    newest = per_type.filter(F.col("r") <= FIND).select("effective_type", "effective_date", "id")
    counts = docs.groupBy("effective_type").agg(F.count("*").alias("n"))
    left = wanted.select("ask", F.explode(F.array_except(F.lit(dims.NAMES), "excluded")).alias("effective_type"))
    hits = _first(left.join(newest, "effective_type"), FIND, F.desc("effective_date"), F.col("id"))
    tally = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("effective_type").alias("doc_type"), "n")))
    totals = left.join(counts, "effective_type").groupBy("ask").agg(F.sum("n").alias("total"), tally.alias("counts"))
    return hits.select("ask", "rank", F.col("id").cast("string").alias("item"), "effective_type"), totals


def _matching(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(ask, total, owners): what the types, the person and the period of a search cover, and whose it is, the newest
    first: from counts of each type, day and owner."""
    counts = docs.groupBy("effective_type", "effective_date", F.trim("owner_name").alias("owner")).agg(F.count("*").alias("n"))
    asked = wanted.select("ask", "first", "last", F.explode("types").alias("effective_type")).distinct()
    met = asked.join(counts, "effective_type").filter(F.coalesce(F.col("effective_date") >= F.col("first"), F.lit(True)) & F.coalesce(F.col("effective_date") <= F.col("last"), F.lit(True)))
    own = met.groupBy("ask", "owner").agg(F.sum("n").alias("n"), F.max("effective_date").alias("newest"))
    ranked = own.withColumn("r", F.when(F.coalesce("owner", F.lit("")) != "", F.row_number().over(Window.partitionBy("ask", F.coalesce("owner", F.lit("")) != "").orderBy(F.desc("newest"), "owner"))))
    names = F.sort_array(F.collect_list(F.when(F.col("r") <= answers.SHOWN_OWNERS, F.struct("r", "owner"))))
    return ranked.groupBy("ask").agg(F.sum("n").alias("total"), F.transform(names, lambda x: x["owner"]).alias("owners"))


def _photos(wanted: DataFrame, photos: DataFrame) -> DataFrame:
    """The newest photos at a place, or of a category; for trips and places those of trips come first."""
    start, end = period_millis(F.col("first"), F.col("last"))
    asked = wanted.select("ask", "category", F.lower("place").alias("at"), start.alias("start"), end.alias("end"))
    own = photos.select("uri", "taken_at", F.col("category").alias("kind"), F.lower("place").alias("where"), F.col("trip_id").isNotNull().alias("trip"))
    at_place = asked.filter("at is not null").join(own, (F.col("at") == F.col("where")) & F.coalesce(F.col("category") == F.col("kind"), F.lit(True)))
    lists = F.when(F.col("trip"), F.array(F.struct(F.lit("places").alias("list"), F.lit(0).alias("turn")), F.when(F.col("kind") != "places", F.struct(F.col("kind").alias("list"), F.lit(1).alias("turn"))))).otherwise(F.array(F.struct(F.col("kind").alias("list"), F.lit(1).alias("turn"))))
    filed = own.select("uri", "taken_at", F.explode(F.array_compact(lists)).alias("l")).select("uri", "taken_at", "l.list", "l.turn")
    of_kind = asked.filter("at is null").join(filed, F.col("category") == F.col("list"))
    both = at_place.select("ask", "uri", "taken_at", "start", "end", F.lit(0).alias("turn")).unionByName(of_kind.select("ask", "uri", "taken_at", "start", "end", "turn"))
    return _first(both.filter(F.col("taken_at").between(F.col("start"), F.col("end"))), PHOTOS, F.col("turn"), F.desc("taken_at"), F.col("uri")).select("ask", "rank", F.col("uri").alias("item"))


def _reminders(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document that expires, the soonest first, of the types that are asked for and not ruled out."""
    kinds = F.array_except(F.when(F.size("types") > 0, F.col("types")).otherwise(F.lit(dims.NAMES)), "excluded")
    due = docs.filter("expiry_on is not null").select("effective_type", "expiry_on", "id")
    met = wanted.select("ask", F.explode(kinds).alias("effective_type")).join(due, "effective_type")
    order = Window.partitionBy("ask").orderBy("expiry_on", "id")
    return met.select("ask", F.row_number().over(order).alias("rank"), F.col("id").cast("string").alias("item"), "effective_type")


def answered(wanted: DataFrame, *, docs: DataFrame, photos: DataFrame, find: Callable[[DataFrame], DataFrame], owner: str | None = None) -> DataFrame:
    """The answers to asks(): (ask, branch, messages, note, total, reply, rank, item), one row for each hit, or one without.

    Every branch works on all its asks at once, and their rows are united: photos by place, category and trips; documents
    searched (find: (ask, text, types, excluded, first, last) to (ask, id, place), see searcher()); overviews; what a
    follow-up points at; reminders; tasks by their template; small talk. note says why there may be nothing: no_other (all
    of it was shown before), text_only (the reply says it), or none. docs: id, effective_type, effective_date, expiry_on,
    owner_name; with `owner`, only those of owners whose name holds it.
    """
    own = docs.filter(owned_by(F.col("owner_name"), owner)) if owner else docs
    searched = wanted.filter(F.col("branch").isin(_SEARCHES))
    plain, overviews = searched.filter("not overview"), searched.filter("overview")
    newest, tallies = _overviews(overviews, own)
    pointed = wanted.filter("pointed is not null").select("ask", F.posexplode("pointed").alias("r", "d"))
    parts = [
        _found(plain, own, find),
        newest,
        pointed.select("ask", (F.col("r") + 1).alias("rank"), F.col("d.id").cast("string").alias("item"), F.col("d.doc_type").alias("effective_type")),
        _reminders(wanted.filter("branch = 'reminders'"), own),
        _photos(wanted.filter("branch = 'photos'"), photos).withColumn("effective_type", F.lit(None).cast("string")),
        wanted.filter("branch = 'pack'").select("ask", F.lit(1).alias("rank"), F.col("template").alias("item"), F.lit(None).cast("string").alias("effective_type")),
    ]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = stored(hits, "hits")
    shown = hits.filter(F.col("rank") <= FIND).groupBy("ask").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "effective_type"))), lambda x: x["effective_type"]).alias("kinds"))
    sums = _matching(plain.filter("size(types) > 0"), own).select("ask", "total", "owners", F.lit(None).cast("array<struct<m:bigint,doc_type:string,n:bigint>>").alias("counts"))
    sums = sums.unionByName(tallies.select("ask", "total", F.lit(None).cast("array<string>").alias("owners"), "counts"))
    told = wanted.join(shown, "ask", "left").join(sums, "ask", "left")
    branch, none = F.col("branch"), F.col("n").isNull()
    search_like = branch.isin(_SEARCHES) & ~F.col("overview")
    unclear = F.size("types") == 0
    seen = F.coalesce(F.size("hidden") > 0, F.lit(False))
    text_only = F.when(branch == "question", unclear).otherwise((F.col("action") == "advice") | (unclear & F.col("template").isNull()))
    note = F.when(search_like & none, F.when(seen, "no_other").when(F.coalesce(text_only, F.lit(False)), "text_only"))
    empty = F.array().cast("array<string>")
    kinds = F.coalesce("kinds", empty)
    total = F.when(search_like, F.greatest(F.coalesce("total", F.lit(0)), F.coalesce("n", F.lit(0)))).when(F.col("overview"), F.coalesce("total", F.lit(0)))
    summary = answers.summary(F.col("types"), kinds, total, F.coalesce("owners", empty), F.col("order"), F.col("action"))
    pointed_at = answers.summary(F.array_distinct(kinds), kinds, F.size(kinds), empty, F.lit("latest"), F.col("action"))
    reply = (
        F.when(branch == "chat", answers.chat_reply(F.col("chat_kind")))
        .when(F.col("overview"), F.when(total > 0, answers.overview(total, F.col("counts"), F.col("excluded"))).otherwise(answers.WORDING["nothing"]))
        .when(search_like & none, answers.no_match(F.col("types"), F.col("action"), seen))
        .when(branch.isin("find", "follow_up_again"), summary)
        .when(branch == "follow_up_show", pointed_at)
    )
    told = told.select("ask", "branch", "messages", note.alias("note"), total.cast("long").alias("total"), reply.alias("reply"))
    return told.join(hits.select("ask", "rank", "item"), "ask", "left")


def cited_first(hits: DataFrame, *, by: str = "query_id") -> DataFrame:
    """hits (rank, cited) in a new order: those that the answer cites come first."""
    order = Window.partitionBy(by).orderBy(F.desc("cited"), "rank")
    return hits.withColumn("place", F.row_number().over(order))
