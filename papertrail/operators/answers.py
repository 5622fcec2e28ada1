"""Replies from templates: counts, owners, overviews, small talk; and which citations stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail import dims

# The engine's own wording; another language's is given as a parameter with the same keys.
WORDING = {
    "nothing": "Nothing saved matches that.",
    "found_one": "Found 1 document: %s.",
    "found_many": "Found %d documents: %s.",
    "one": "Here is your %s.",
    "count": "%s: %d saved.",
    "count_owners": "%s: %d saved, for %s.",
    "latest": "Showing the latest %d.",
    "oldest": "Showing the oldest %d.",
    "overview": "You have %d documents: %s.",
    "excluding": "Left out: %s.",
    "no_other": "There is no other one saved.",
    "no_other_typed": "There is no other %s saved.",
    "unclear": "Which document do you mean?",
    "advice_none": "No %s is saved, and procedures can't be looked up here.",
    "share": "Use share to send it.",
    "delete": "Deleting is done on the document's own page.",
    "edit": "Names and types are changed on the document's own page.",
    "advice": "Procedures can't be looked up here; this is the saved copy.",
    "greeting": "Hello! Ask for any of your documents.",
    "thanks": "You're welcome.",
    "help": "I find your documents, answer questions about them and list what a task needs.",
    "bye": "Goodbye.",
    "privacy": "Everything stays on this device.",
    "offtopic": "I only know your documents and photos.",
}
SHOWN_OWNERS, SHOWN_TYPES, CITED = 4, 5, 3


def _say(key: str, *args: Column, wording: dict[str, str] | None = None) -> Column:
    return F.format_string((wording or WORDING)[key], *args) if args else F.lit((wording or WORDING)[key])


def names_of(types: Column) -> Column:
    return F.array_join(F.transform(F.array_distinct(types), dims.label_of), ", ")


def summary(asked: Column, shown_types: Column, total: Column, owners: Column, order: Column, action: Column) -> Column:
    """What was found: for one type asked for the total, its owners and how many are shown; else the types; then the action's note."""
    n = F.size(shown_types)
    one = F.size(asked) == 1
    label = dims.label_of(F.try_element_at(asked, F.lit(1)))
    plain = F.when(n == 1, _say("found_one", names_of(shown_types))).otherwise(_say("found_many", n, names_of(shown_types)))
    count = F.when(F.size(owners) == 0, _say("count", label, total)).otherwise(_say("count_owners", label, total, F.array_join(F.slice(owners, 1, SHOWN_OWNERS), ", ")))
    some = F.when(n < total, F.when(order == "oldest", _say("oldest", n)).otherwise(_say("latest", n)))
    base = F.when(n == 0, _say("nothing")).when(~one, plain).when(total <= 1, _say("one", label)).otherwise(F.concat_ws(" ", count, some))
    note = F.coalesce(*(F.when(action == k, _say(k)) for k in ("share", "delete", "edit", "advice")))
    return F.concat_ws(" ", base, note)


def overview(total: Column, counts: Column, excluded: Column) -> Column:
    """counts: array of (type, n), the most frequent first."""
    listed = F.array_join(F.transform(F.slice(counts, 1, SHOWN_TYPES), lambda x: F.concat(dims.label_of(x["doc_type"]), F.lit(" "), x["n"].cast("string"))), ", ")
    left_out = F.when(F.size(excluded) > 0, _say("excluding", names_of(excluded)))
    return F.concat_ws(" ", _say("overview", total, listed), left_out)


def chat_reply(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, _say(k)) for k in ("greeting", "thanks", "help", "bye", "privacy")), _say("offtopic"))


def no_match(types: Column, action: Column, seen: Column) -> Column:
    """Why there is nothing: all of them were shown before; advice without a document; an unclear message; or nothing saved."""
    label = dims.label_of(F.try_element_at(types, F.lit(1)))
    again = F.when(F.size(types) == 1, _say("no_other_typed", label)).otherwise(_say("no_other"))
    return F.when(seen, again).when(action == "advice", _say("advice_none", F.coalesce(label, F.lit("document")))).when(F.size(types) == 0, _say("unclear")).otherwise(_say("nothing"))


def citations(cited: Column, allowed: Column) -> tuple[Column, Column]:
    """Those of documents the model was given, each once; and those that it made up."""
    return F.array_intersect(cited, allowed), F.filter(cited, lambda x: ~F.array_contains(allowed, x))


def title(doc_type: Column, owner: Column, issued: Column, expiry: Column, amount: Column) -> Column:
    """A document's title: label, owner, month or date, amount, with dots between."""
    month = F.when(doc_type.isin(dims.MONTHLY), F.date_format(issued, "MMM yyyy")).otherwise(F.date_format(issued, "d MMM yyyy"))
    until = F.when(doc_type.isin([t.name for t in dims.DOC_TYPES if t.expires]) & expiry.isNotNull(), F.concat(F.lit("valid till "), F.date_format(expiry, "d MMM yyyy")))
    paid = F.when(doc_type.isin(dims.BILLS), F.concat(F.lit("₹"), amount))
    return F.concat_ws(" · ", dims.label_of(doc_type), owner, F.coalesce(until, month), paid)
