"""Saved conversations: turns as JSON and back, and what of them may still be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chat keeps its last fifty turns, and thirty chats are kept.
CHATS, TURNS = 30, 50
TURN = "struct<query:string,kind:string,text:string,doc_ids:array<bigint>,cited_ids:array<bigint>,template_id:string,doc_types:array<string>>"


def saved(turns: DataFrame) -> DataFrame:
    """(chat_id, updated_at, json): a chat's last turns, in order; the newest thirty chats."""
    fields = ["query", "kind", "text", "doc_ids", "cited_ids", "template_id", "doc_types"]
    last = turns.groupBy("chat_id").agg(F.max("at").alias("updated_at"), F.sort_array(F.collect_list(F.struct("at", *fields))).alias("t"))
    kept = F.transform(F.slice("t", F.greatest(F.lit(1), F.size("t") - TURNS + 1), F.lit(TURNS)), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return last.select("chat_id", "updated_at", F.to_json(kept).alias("json")).orderBy(F.desc("updated_at"), "chat_id").limit(CHATS)


def restored(chats: DataFrame, docs: DataFrame) -> DataFrame:
    """(chat_id, turn, query, kind, text, doc_ids): documents that are gone are left out; unknown JSON fields are ignored."""
    rows = chats.select("chat_id", F.posexplode(F.from_json("json", f"array<{TURN}>")).alias("turn", "t")).select("chat_id", "turn", "t.*")
    asked = rows.select("chat_id", "turn", F.posexplode("doc_ids").alias("place", "id"))
    there = asked.join(docs.select("id"), "id", "left_semi").groupBy("chat_id", "turn").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("x"))
    found = rows.drop("doc_ids").join(there, ["chat_id", "turn"], "left")
    ids = F.coalesce(F.transform("x", lambda x: x["id"]), F.array().cast("array<bigint>"))
    return found.select("chat_id", "turn", "query", "kind", "text", ids.alias("doc_ids"))


def fully_masked(valid_numbers: Column, covered_numbers: Column) -> Column:
    """Fail closed: a page may be shared only if every valid number on it is covered."""
    return F.size(valid_numbers) == F.coalesce(F.size(F.array_intersect(valid_numbers, covered_numbers)), F.lit(-1))
