"""Documents as kept: derived columns, filters, row-level changes, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail import dims

#: Flags in needs_llm: the type, the expiry date.
NEEDS_TYPE, NEEDS_EXPIRY = 1, 2
PROMPT_VERSION = 1


def with_derived(docs: DataFrame, today: Column) -> DataFrame:
    """type, is_type_confident, effective_type, effective_date, doc_category, expired, display_title."""
    kind = F.coalesce(dims.parse_type(F.col("doc_type")), F.lit(dims.OTHER))
    sure = F.col("is_user_confirmed") | (F.col("doc_type_confidence") >= dims.CONFIDENT)
    out = docs.withColumns({"type": kind, "is_type_confident": sure, "effective_type": F.when(sure, kind).otherwise(dims.OTHER)})
    out = out.withColumns({"effective_date": F.coalesce("issued_on", F.to_date("captured_at")), "doc_category": dims.category_of(F.col("effective_type")), "expired": F.coalesce(F.col("expiry_on") < today, F.lit(False))})
    return out.withColumn("display_title", display_title(F.col("title_en"), F.col("effective_type")))


def display_title(title: Column, effective_type: Column) -> Column:
    """The title without the longest type label that it begins with, if that isn't the effective type's, and without a dot after it."""
    by_length = sorted(dims.DOC_TYPES, key=lambda t: -len(t.label))
    cut = None
    for t in by_length:
        rest = F.when(effective_type != t.name, F.substring(title, F.lit(len(t.label) + 1), F.length(title))).otherwise(title)
        cut = F.when(title.startswith(t.label), rest) if cut is None else cut.when(title.startswith(t.label), rest)
    return F.trim(F.regexp_replace(F.trim(cut.otherwise(title)), "^·", ""))


def summary(docs: DataFrame) -> DataFrame:
    return docs.select("id", "effective_type", "effective_date", "expiry_on", "owner_name", F.col("doc_type_confidence").alias("confidence"), F.col("is_user_confirmed").alias("confirmed"))


def owned_by(owner: Column, wanted: str | None) -> Column:
    """Nobody asked for: all pass. Else the owner's name must hold the wanted one, whatever the case; no owner fails."""
    if wanted is None or not wanted.strip():
        return F.lit(True)
    return F.coalesce(F.contains(F.lower(owner), F.lit(wanted.lower())), F.lit(False))


def dated_within(day: Column, first: Column | None, last: Column | None) -> Column:
    """Both ends belong to the period; either may be open."""
    ok = F.lit(True)
    if first is not None:
        ok = ok & F.coalesce(day >= first, first.isNull())
    if last is not None:
        ok = ok & F.coalesce(day <= last, last.isNull())
    return ok


def period_millis(first: Column, last: Column) -> tuple[Column, Column]:
    """A period of days as milliseconds: from the start of its first day to the last one of its last; open ends as 0 and the largest number."""
    start = F.coalesce(F.unix_millis(first.cast("timestamp")), F.lit(0).cast("long"))
    end = F.coalesce(F.unix_millis(F.date_add(last, 1).cast("timestamp")) - 1, F.lit((1 << 63) - 1))
    return start, end


def listed(docs: DataFrame, *, group: str | None = None, person: str | None = None, text: str | None = None) -> DataFrame:
    """The list screen's filters: a category or an exact type; an exact person; a text within type label or owner."""
    if group is not None:
        docs = docs.filter((F.col("doc_category") == group) | (F.col("effective_type") == group))
    if person is not None:
        docs = docs.filter(F.col("owner_name") == person)
    if text:
        needle = F.lit(text.lower())
        docs = docs.filter(F.contains(F.lower(dims.label_of(F.col("effective_type"))), needle) | F.coalesce(F.contains(F.lower("owner_name"), needle), F.lit(False)))
    return docs


def lenient_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike("screenshot|download|whatsapp documents"), F.lit(False))


def pending_enrichment(docs: DataFrame, version: int = PROMPT_VERSION) -> DataFrame:
    """Unconfirmed rows that a flag marks, whose type no model has settled, or that an older prompt has judged."""
    unsure = (F.col("doc_type_confidence") < dims.CONFIDENT) & (F.col("doc_type_source") != "llm")
    return docs.filter(~F.col("is_user_confirmed") & ((F.col("needs_llm") != 0) | unsure | (F.coalesce("prompt_version", F.lit(0)) < version)))


def still_asked_for(shown: DataFrame, docs: DataFrame, asked: Sequence[str]) -> DataFrame:
    """Shown rows (id, doc_type) whose document is still there with the same type, and among the types asked for, if any are."""
    now = docs.select(F.col("id").alias("_id"), F.col("doc_type").alias("_type"))
    kept = shown.join(now, (F.col("id") == F.col("_id")) & (F.col("doc_type") == F.col("_type")), "left_semi")
    return kept.filter(F.col("doc_type").isin(list(asked))) if asked else kept


def latest_per_key(rows: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """Upsert: of rows with one key the newest. A group is reduced where it lies before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*newest))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def insert_ignore(kept: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose key isn't there yet are added, the first of each; all others are as they were."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*kept.columns)
    return kept.unionByName(first.join(kept.select(*keys), list(keys), "left_anti").select(*kept.columns))


def upsert(kept: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new replace those with their key."""
    return kept.join(new.select(*keys), list(keys), "left_anti").select(*kept.columns).unionByName(new.select(*kept.columns))


def update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns of the rows where the condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_cascade(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Tables without the rows whose key is in gone (column id): documents and all that belongs to them."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    return {name: df.join(ids, df[key] == ids["_gone"], "left_anti") for name, (df, key) in tables.items()}


def edited(docs: DataFrame, where: Column, *, doc_type: str | None = None, expiry_on: Column | None = None, owner_name: str | None = None) -> DataFrame:
    """A user's correction: it confirms the row, and clears the flag of what it settles."""
    values: dict[str, Column] = {"is_user_confirmed": F.lit(True)}
    settled = 0
    if doc_type is not None:
        values |= {"doc_type": F.lit(doc_type), "doc_type_confidence": F.lit(1.0), "doc_type_source": F.lit("user")}
        settled |= NEEDS_TYPE
    if expiry_on is not None:
        values |= {"expiry_on": expiry_on}
        settled |= NEEDS_EXPIRY
    if owner_name is not None:
        values |= {"owner_name": F.lit(owner_name)}
    values["needs_llm"] = F.col("needs_llm").bitwiseAND(F.lit(~settled))
    return update(docs, where, **values)


def merged_verdict(rule_type: Column, verdict: Column) -> tuple[Column, Column]:
    """A model's verdict on an unsure type: agreement and 'other' count 0.9, a different type is taken at 0.6."""
    kind = F.coalesce(dims.parse_type(verdict), rule_type)
    return kind, F.when((kind == rule_type) | (kind == dims.OTHER), 0.9).otherwise(0.6)


def ring(rows: DataFrame, key: Sequence[str], newest: Sequence[Column], most: int) -> DataFrame:
    """The newest rows of each key, at most so many. Ranks beyond that are dropped before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def page_of_offset(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, offset, page): a page's text is followed by one separator. Offsets beyond the end are on the last page."""
    w = Window.partitionBy("doc_id").orderBy("page")
    spans = pages.withColumn("_end", F.sum(F.length("text") + 1).over(w)).withColumn("_start", F.col("_end") - F.length("text") - 1)
    spans = spans.withColumn("_last", F.lead("page").over(w).isNull())
    inside = (F.col("offset") >= F.col("_start")) & ((F.col("offset") < F.col("_end")) | F.col("_last"))
    return offsets.join(spans, "doc_id").filter(inside).select("doc_id", "offset", "page")
