"""Checklists: which documents a task needs, which are there, and reminders before they expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days before expiry on which to remind, and the hour.
OFFSETS, HOUR = [30, 7, 1], 9


def candidates(items: DataFrame, docs: DataFrame, today: Column, *, pinned: DataFrame | None = None) -> DataFrame:
    """Every document of an item's type with its verdict: found, or why not (extra, same_month, too_old, expired).

    docs: id, effective_type, effective_date, expiry_on, confirmed, confidence; they may have further key columns, as
    for many owners at once: pass those as columns of `docs` named owner. Newest first, then confirmed, then confident.
    """
    found = docs.join(F.broadcast(items.withColumnRenamed("doc_type", "effective_type")), "effective_type")
    found = found.withColumn("_pin", F.lit(False)) if pinned is None else found.join(pinned.select("id", F.lit(True).alias("_p")), "id", "left").withColumn("_pin", F.coalesce("_p", F.lit(False))).drop("_p")
    month = F.trunc("effective_date", "month")
    oldest = F.trunc(F.add_months(today, -F.col("months")), "month")
    recent = F.col("effective_date") >= F.add_months(today, -F.col("months"))
    fits = (
        F.when(F.col("rule").isNull(), True)
        .when(F.col("rule") == "within_months", recent)
        .when(F.col("rule") == "distinct_months", month >= oldest)
        .when(F.col("rule") == "not_expired", F.col("expiry_on").isNull() | (F.col("expiry_on") >= today))
        .when(F.col("rule") == "most_recent", (F.col("months") <= 0) | recent)
    )
    order = [F.desc("_pin"), F.desc("effective_date"), F.desc("confirmed"), F.desc("confidence"), F.asc("id")]
    found = found.withColumns({"_fits": F.coalesce(fits, F.lit(False)) | F.col("_pin"), "_month": month})
    key = ["owner", "template", "position"]
    again = F.row_number().over(Window.partitionBy(*key, "_fits", "_month").orderBy(*order))
    found = found.withColumn("_again", (F.col("rule").eqNullSafe("distinct_months")) & F.col("_fits") & (again > 1))
    found = found.withColumn("_rank", F.row_number().over(Window.partitionBy(*key, "_fits", "_again").orderBy(*order)))
    why = F.when(~F.col("_fits"), F.when(F.col("rule") == "not_expired", "expired").otherwise("too_old")).when(F.col("_again"), "same_month").when(F.col("_rank") > F.col("n"), "extra").otherwise("found")
    return found.select(*key, "effective_type", "n", "optional", "id", why.alias("verdict"), F.col("_rank").alias("rank"))


def statuses(judged: DataFrame, items: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, template, position, doc_type, found, status) for every item: complete, partial, missing, optional_missing."""
    counts = judged.filter("verdict = 'found'").groupBy("owner", "template", "position").agg(F.count("*").alias("found"))
    every = owners.select("owner").distinct().crossJoin(F.broadcast(items))
    own = every.join(counts, ["owner", "template", "position"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    status = F.when(F.col("found") >= F.col("n"), "complete").when(F.col("optional") & (F.col("found") == 0), "optional_missing").when(F.col("found") > 0, "partial").otherwise("missing")
    return own.select("owner", "template", "position", "doc_type", F.col("found").cast("long").alias("found"), status.alias("status"))


def pack(judged: DataFrame) -> DataFrame:
    """(owner, template, place, id): the found documents in the order of the template, each once."""
    found = judged.filter("verdict = 'found'").groupBy("owner", "template", "id").agg(F.min(F.struct("position", "rank")).alias("at"))
    return found.select("owner", "template", F.row_number().over(Window.partitionBy("owner", "template").orderBy("at", "id")).alias("place"), "id")


def reminders(docs: DataFrame, now: Column) -> DataFrame:
    """(doc_id, offset_days, fire_at, state) for every document with an expiry date; what is past is skipped."""
    rows = docs.filter("expiry_on is not null").select(F.col("id").alias("doc_id"), "expiry_on", F.explode(F.array(*map(F.lit, OFFSETS))).alias("offset_days"))
    fire = F.date_sub("expiry_on", F.col("offset_days")).cast("timestamp") + F.expr(f"INTERVAL {HOUR} HOURS")
    return rows.select("doc_id", "offset_days", fire.alias("fire_at")).withColumn("state", F.when(F.col("fire_at") <= now, "skipped_past").otherwise("scheduled"))


def due(scheduled: DataFrame, now: Column) -> DataFrame:
    """The re-arm scan: scheduled reminders that are due are fired."""
    return scheduled.withColumn("state", F.when((F.col("state") == "scheduled") & (F.col("fire_at") <= now), "fired").otherwise(F.col("state")))
