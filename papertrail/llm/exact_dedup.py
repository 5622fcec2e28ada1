"""Exact duplicates by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import join_groups, membership, stored, whole_row, with_suspects, without


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for every row of docs: id, keep_id, group_size, kept, n_bytes, full_hash, and the columns named in extra.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays.

    Refinement: rows are first grouped by length and by the hash of the first `prefix` characters (grouped counts, with
    map-side combine: a length that a third of all rows share is a few rows for each task). Only rows whose length and
    prefix occur more than once get their full content hashed (SHA-256); which these are is told by a membership table
    of at most 2**20 rows, whose false alarms cost a hash and change nothing. Rows move between executors without
    their texts, and those of very large groups don't move (see join_groups).

    Repeated rows (same id and text): exactly one of them stays. Ids may be of any type that has an order. A null id
    counts as smaller than any other, and if all ids of a group are null one row stays, keep_id being null. Empty texts
    are one group. Only the id, the text and what extra names are read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_bytes, head = F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, prefix))
    coarse = docs.select(n_bytes.alias("n"), head.alias("p"))
    same = stored(coarse.groupBy("n", "p").agg(F.count("*").alias("rows")).filter("rows > 1").select("n", "p"), "coarse")
    again = membership(same.select(F.xxhash64("n", "p").alias("h")), "h")
    more = F.struct(F.lit(0).alias("_"), *(c.alias(k) for k, c in (extra or {}).items()))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), n_bytes.alias("n_bytes"), head.alias("p"), more.alias("more"))
    rows = with_suspects(rows, again, F.xxhash64("n_bytes", "p"))
    rows = rows.select("id", "n_bytes", F.when(F.col("_suspect"), F.sha2("text", 256)).alias("full_hash"), F.monotonically_increasing_id().alias("row"), "more")
    rows = stored(rows, "hashed")
    last = F.max(F.struct(F.col("id").isNotNull().alias("there"), "id", "row"))
    alike = rows.filter("full_hash is not null")
    groups = alike.groupBy("n_bytes", "full_hash").agg(last.alias("last"), F.count("*").alias("size"))
    groups = stored(groups.filter("size > 1").select(F.col("n_bytes").alias("n"), F.col("full_hash").alias("f"), F.col("last.id").alias("keep"), F.col("last.row").alias("keep_row"), "size"), "groups")
    suspects = join_groups(alike, groups, lambda a, g: (a["full_hash"] == g["f"]) & (a["n_bytes"] == g["n"]), "size")
    alone = rows.filter("full_hash is null").withColumns({"keep": F.col("id"), "keep_row": F.col("row"), "size": F.lit(1).cast("long")})
    both = suspects.select(*alone.columns).unionByName(alone)
    size = F.coalesce("size", F.lit(1).cast("long"))
    return both.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        size.alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        "n_bytes",
        "full_hash",
        *(F.col(f"more.`{k}`") for k in extra or {}),
    )


def drop_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep, all columns as they were, however they are named.

    Of rows that agree in id and text one stays, whichever their other columns: the one with the smallest other columns
    as text. Nulls: a null text is an empty one, a null id the smallest; nulls in other columns stay. Texts of rows that
    stay anyway are not shuffled. An empty table gives an empty table.
    """
    found = exact_groups(docs, id_col=id_col, text_col=text_col).filter("not kept or group_size > 1")
    shown = found.groupBy(F.col(id_col).alias("id"), F.col("full_hash").alias("digest")).agg(F.max("kept").alias("any_kept"), F.count("*").alias("n"))
    shown = stored(shown, "decided")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keys = {"id": F.col(id_col), "digest": digest}
    gone = shown.filter("not any_kept").select("id", "digest")
    twice = shown.filter("any_kept and n > 1").select("id", "digest")
    left = without(docs, gone, keys)
    if twice.limit(1).count() == 0:
        return left
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != text_col)))
    keyed = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("i"), digest.alias("d"), others.alias("others"))
    repeated = keyed.join(twice, keyed["i"].eqNullSafe(twice["id"]) & (keyed["d"] == twice["digest"]), "left_semi")
    one = repeated.groupBy("i", "d").agg(F.min_by("row", "others").alias("row")).select("row.*")
    return without(left, twice, keys).unionByName(one)
