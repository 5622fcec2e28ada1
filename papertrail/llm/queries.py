"""The queries that apply each operator to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.llm import langid, lattice, quality
from papertrail.llm.decontam import contained_items
from papertrail.llm.exact_dedup import exact_groups
from papertrail.llm.filter_audit import interactions
from papertrail.llm.html import extract
from papertrail.llm.negatives import hard_negatives
from papertrail.llm.packing import pack
from papertrail.llm.pii import replace_private
from papertrail.llm.simhash import simhash_components
from papertrail.llm.token_count import token_counts
from papertrail.llm.token_store import token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.labelled_sample(docs, fold("doc_id", 3) != 1, text_col="text", lang_col="lang")
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, learned).select("doc_id", "held_out", "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = exact_groups(table(spark, sf_dir, "documents"), extra={"text_sha256": digest})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    return lattice.score(docs, ~held_out).withColumn("held_out", held_out)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("papertrail.pii.key", "an open key, so that runs of this query can be compared")
    return replace_private(table(spark, sf_dir, "documents"), key=key)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return quality.score(docs, machine, extra={"doc_id": F.col("doc_id"), "held_out": held_out})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label, anchor=F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_simhash_neardup, op2_token_counts, op3_language_id, op4_decontamination, op5_exact_dedup, op6_token_ids, op7_lm_score, op8_html_extraction, op9_packing, op10_pii_surrogates, op11_quality_classifier, op12_hard_negatives, op13_filter_audit]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": DECONTAMINATION, "op5_exact_dedup": EXACT_DEDUP, "op12_hard_negatives": HARD_NEGATIVES, "op13_filter_audit": FILTER_AUDIT}


DECONTAMINATION = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark
), item AS (
  SELECT DISTINCT id AS item_id, least(5, len(w)) AS k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE kind = 'i' AND len(w) > 0)
), doc AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM item) WHERE kind = 'd' AND len(w) >= k)
), size AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM doc JOIN item USING (k, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum([a.x[i] * b.x[i] FOR i IN range(1, len(a.x) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

FILTER_AUDIT = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), f AS (
  SELECT part, coalesce(q, false) AS good, coalesce(x, false) AS toxic, list_value(
      len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
      doc_id > min(doc_id) OVER (PARTITION BY t)) AS fails
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id) USING (doc_id)
), letter AS (
  SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, list_aggregate([substr('ABCDE', x, 1) FOR x IN [a.i, b.i, c.i, d.i, e.i]], 'string_agg', '') AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), fate AS (
  SELECT part, good, toxic, fails, o, filter_order, list_position([fails[x] FOR x IN o], true) AS gone FROM f, orders
), step AS (
  SELECT part, filter_order, s AS step, o[s] AS i,
         count(*) FILTER (gone IS NULL OR gone = 0 OR gone > s) AS kept, count(*) FILTER (gone = s) AS removed,
         count(*) FILTER (fails[o[s]] AND gone < s) AS redundant,
         count(*) FILTER (fails[o[s]] AND len([x FOR x IN fails IF x]) = 1) AS unique_fails,
         count(*) FILTER (gone = s AND good) AS good_lost, count(*) FILTER (gone = s AND toxic) AS toxic_lost
  FROM fate, (SELECT unnest(range(1, 6)) AS s) GROUP BY part, filter_order, o, s
)
SELECT part, filter_order, step::INT AS step, substr('ABCDE', i, 1) AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM step
"""
