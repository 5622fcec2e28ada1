"""The registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from papertrail import dims
from papertrail.functions import ids, text, vectors
from papertrail.lexicon import Lexicon
from papertrail.operators import answers, checklist, chunks, classify, dates, dedup, entities, intents, metrics, owners, search, vault
from papertrail.operators import photos as photo_ops
from papertrail.plans import adapters as a
from papertrail.plans import extraction, messages, pages, streams, upkeep  # noqa: F401  (they register their queries)
from papertrail.plans.registry import ORACLES as MORE
from papertrail.plans.registry import QUERIES, Query, query
from papertrail.plans.sql import ORACLES
from papertrail.sources import readers
from papertrail.storage import shared_dir, spread, stored
from papertrail.streaming import ingest

TODAY = dt.date.fromisoformat(a.TODAY)


# ---- documents: scans, filters, projections, order

@query
def docs_in_other_table(spark, sf):
    """Semi join: documents that have a label."""
    gold = a.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return a.vault(spark, sf).join(gold, "id", "left_semi").select("id", "doc_type", "owner_name")


@query
def docs_newest_first(spark, sf):
    return a.vault(spark, sf).select("id", "captured_at").orderBy(F.desc("captured_at"), "id")


@query
def docs_by_types(spark, sf):
    return a.vault(spark, sf).filter(F.col("doc_type").isin("PAN", "PASSPORT", "SALARY_SLIP")).select("id", "doc_type")


@query
def docs_expiring(spark, sf):
    return a.vault(spark, sf).filter("expiry_on is not null").select("id", "expiry_on", "expired").orderBy("expiry_on", "id")


@query
def docs_recent_topk(spark, sf):
    return a.vault(spark, sf).select("id", "captured_at").orderBy(F.desc("captured_at"), "id").limit(10)


@query
def docs_oldest_of_wide(spark, sf):
    """Two-stage top-k: the newest fifty, of these the six oldest."""
    wide = a.vault(spark, sf).select("id", "effective_date").orderBy(F.desc("effective_date"), "id").limit(50)
    return wide.orderBy("effective_date", "id").limit(6)


@query
def pending_dups(spark, sf):
    return a.vault(spark, sf).filter("dup_of_doc_id is not null").select("id", "dup_of_doc_id")


@query
def derived_columns(spark, sf):
    return a.vault(spark, sf).select("id", "is_type_confident", "effective_type", "effective_date", "doc_category", "expired", "display_title")


@query
def doc_summaries(spark, sf):
    return vault.summary(a.vault(spark, sf))


@query
def owner_filter(spark, sf):
    return a.vault(spark, sf).filter(vault.owned_by(F.col("owner_name"), "SRC1")).select("id", "owner_name")


@query
def owners_distinct(spark, sf):
    return a.vault(spark, sf).filter("trim(owner_name) <> ''").select(F.trim("owner_name").alias("owner")).distinct()


@query
def date_range_filter(spark, sf):
    d = a.vault(spark, sf).filter(vault.dated_within(F.col("effective_date"), a.day("2024-06-01"), a.day("2024-12-31")))
    return d.select("id", "effective_date")


@query
def vault_list_filter(spark, sf):
    d = a.vault(spark, sf)
    return vault.listed(d, group="identity", text="src1").select("id", "effective_type", "owner_name")


@query
def path_leniency(spark, sf):
    return a.photos(spark, sf).groupBy(vault.lenient_path(F.col("path")).alias("lenient")).agg(F.count("*").alias("n"))


@query
def text_density_gate(spark, sf):
    p = a.table(spark, sf, "pages").select("page_id", text.useful_chars(F.regexp_replace("html", "<[^>]*>", " ")).cast("long").alias("useful"))
    return p.withColumn("is_text", F.col("useful") >= 40)


@query
def pending_enrichment(spark, sf):
    d = a.vault(spark, sf).withColumn("prompt_version", (F.col("id") % 2).cast("int"))
    return vault.pending_enrichment(d).select("id", "needs_llm", "doc_type_confidence")


@query
def revalidate_shown(spark, sf):
    d = a.vault(spark, sf)
    shown = d.select("id", F.when(F.col("id") % 9 == 0, "OTHER_DOCUMENT").otherwise(F.col("doc_type")).alias("doc_type"))
    return vault.still_asked_for(shown, d, ["PAN", "TICKET", "PASSPORT"])


@query
def chat_history_ring(spark, sf):
    c = a.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return vault.ring(c, ["conv_id"], [F.desc("turn")], 5)


@query
def page_of_offset(spark, sf):
    d = a.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    offsets = d.groupBy("doc_id").agg(F.sum(F.length("text") + 1).alias("n")).select("doc_id", F.floor(F.col("n") / 2).alias("offset"))
    return vault.page_of_offset(d, offsets)


# ---- changes: insert, upsert, update, delete

def _kv(spark, sf):
    e = a.table(spark, sf, "events")
    kept = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("what"))
    new = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.concat(F.lit("new "), "event_type").alias("what"))
    return kept, new


@query
def insert_ignore(spark, sf):
    kept, new = _kv(spark, sf)
    return vault.insert_ignore(kept, new, ["id"], [F.col("what")])


@query
def upsert_rows(spark, sf):
    kept, new = _kv(spark, sf)
    return vault.upsert(kept, new, ["id"])


@query
def latest_per_user(spark, sf):
    e = a.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return vault.latest_per_key(e, ["user_id"], [F.col("event_id")])


@query
def user_edits(spark, sf):
    d = vault.edited(a.vault(spark, sf), F.col("id") % 6 == 0, doc_type="PAN")
    return d.select("id", "doc_type", "doc_type_source", "is_user_confirmed", F.col("needs_llm").cast("long").alias("needs_llm"))


@query
def owner_names_cleared(spark, sf):
    d = a.vault(spark, sf)
    gone = vault.update(d, F.col("owner_name").isNotNull() & F.col("doc_type").isin("TICKET", "RECEIPT_INVOICE"), owner_name=F.lit(None).cast("string"))
    return gone.groupBy("doc_type").agg(F.count("owner_name").alias("owned"), F.count("*").alias("docs"))


@query
def cascade_delete(spark, sf):
    d = a.vault(spark, sf)
    tables = {"documents": (d.select("id"), "id"), "labels": (a.table(spark, sf, "labels"), "doc_id"), "vectors": (a.vectors(spark, sf), "doc_id")}
    left = vault.delete_cascade(d.filter("dup_of_doc_id is not null"), tables)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def model_verdicts(spark, sf):
    kind, sure = vault.merged_verdict(F.col("doc_type"), F.when(F.col("id") % 3 == 0, F.col("doc_type")).when(F.col("id") % 3 == 1, F.lit("other_document")).otherwise(F.lit("TICKET")))
    return a.vault(spark, sf).filter(~F.col("is_type_confident")).select("id", kind.alias("merged_type"), sure.alias("confidence"))


# ---- aggregates

@query
def table_counts(spark, sf):
    return a.vault(spark, sf).agg(F.count("*").alias("documents")).join(a.vectors(spark, sf).agg(F.count("*").alias("chunks")))


@query
def status_counts(spark, sf):
    return ingest.status_counts(a.index_state(spark, sf))


@query
def category_counts(spark, sf):
    return a.photos(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query
def trip_distinct_count(spark, sf):
    return a.photos(spark, sf).agg(F.countDistinct("trip_id").alias("trips"))


@query
def overview_top_types(spark, sf):
    return a.vault(spark, sf).groupBy("effective_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "effective_type").limit(5)


@query
def suggestions(spark, sf):
    top = a.vault(spark, sf).filter(F.col("effective_type") != dims.OTHER).groupBy("effective_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "effective_type").limit(3)
    return top.select("effective_type", F.concat(F.lit("Show my "), F.lower(dims.label_of(F.col("effective_type")))).alias("suggestion"))


@query
def doc_category_counts(spark, sf):
    return a.vault(spark, sf).filter("source_kind = 'gallery'").groupBy("doc_category").agg(F.count("*").alias("n"))


@query
def index_funnel(spark, sf):
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long").alias(s)
    return a.index_state(spark, sf).agg(n("done"), n("skipped_non_doc"), n("failed"), n("pending"), F.count("*").alias("total"))


@query
def latency_percentiles(spark, sf):
    e = a.table(spark, sf, "events").select("event_type", "event_id", "value")
    return metrics.latency(e, series="event_type", value="value", newest=[F.desc("event_id")]).withColumn("avg", F.round("avg", 6))


@query
def ingest_throughput(spark, sf):
    t = metrics.throughput(a.index_state(spark, sf), status="status", ms=F.col("value"))
    return t.select("done", "failed", "remaining", F.round("ms_per_item", 6).alias("ms_per_item"), F.round("eta_ms", 3).alias("eta_ms"))


@query
def eval_hit_at_3(spark, sf):
    """Nearest vectors' labels against each vector's own: every vector with an id divisible by 20 is a case."""
    v = a.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    cases = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("q"), F.col("label").alias("expected"))
    found = search.vector_search(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), cases.select(F.col("case_id").alias("query_id"), F.col("q").alias("vector")), k=4)
    others = found.filter("doc_id <> query_id")  # a case finds itself first
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    ranked = others.select(F.col("query_id").alias("case_id"), "doc_id", nth.alias("rank")).join(v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("got")), "doc_id")
    cases = cases.select("case_id", "expected", F.when(F.col("expected") < 5, "a").otherwise("b").alias("lang"))
    return metrics.hit_at(ranked, cases, by=["lang"])


# ---- items and photos

@query
def incremental_scan(spark, sf):
    return readers.changed_since(a.index_state(spark, sf), 500, version="1", last_version="1").select("uri", "generation")


@query
def next_watermark(spark, sf):
    return readers.next_watermark(a.index_state(spark, sf), 500)


@query
def pending_queue_topk(spark, sf):
    return readers.queue(a.index_state(spark, sf)).select("uri", "generation")


@query
def skipped_recent_topk(spark, sf):
    return a.index_state(spark, sf).filter("status = 'skipped_non_doc'").select("uri", "updated_at").orderBy(F.desc("updated_at"), "uri").limit(25)


@query
def unfiled_items(spark, sf):
    filed = a.photos(spark, sf).filter("id % 2 = 0")
    return ingest.unfiled(a.index_state(spark, sf), filed).select("uri", "status")


@query
def photos_by_category_range(spark, sf):
    start, end = vault.period_millis(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    p = a.photos(spark, sf).filter((F.col("category") == "food") & F.col("taken_at").between(start, end))
    return p.select("uri", "taken_at").orderBy(F.desc("taken_at"), "uri").limit(60)


@query
def photos_at_place(spark, sf):
    p = a.photos(spark, sf).filter((F.lower("place") == F.lower(F.lit("Nation_7"))) & (F.lit(None).cast("string").isNull() | (F.col("category") == "food")))
    return p.select("uri", "taken_at").orderBy(F.desc("taken_at"), "uri").limit(60)


@query
def photos_in_trips(spark, sf):
    return a.photos(spark, sf).filter("trip_id is not null").select("uri", "trip_id", "taken_at").orderBy(F.desc("taken_at"), "uri")


@query
def distinct_places(spark, sf):
    return a.photos(spark, sf).filter("place is not null").select("place").distinct()


@query
def unplaced_photos(spark, sf):
    return a.photos(spark, sf).filter("lat is not null and lon is not null and place is null").select("uri", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query
def photos_with_documents(spark, sf):
    """Left lookup: a photo's document may be gone."""
    d = a.vault(spark, sf).select(F.col("id").alias("doc_id"), "effective_type")
    return a.photos(spark, sf).filter("doc_id is not null").join(d, "doc_id", "left").select("uri", "doc_id", "effective_type")


@query
def trips_then_category(spark, sf):
    p = a.photos(spark, sf)
    return photo_ops.trip_photos_first(p.filter("trip_id is not null"), p.filter("category = 'places'"))


@query
def home_cells(spark, sf):
    h = photo_ops.home_cells(a.photos(spark, sf))
    return h.select("user_id", F.round("home_lat", 6).alias("home_lat"), F.round("home_lon", 6).alias("home_lon"), "days", "photos")


@query
def trips(spark, sf):
    return photo_ops.trips(a.photos(spark, sf).drop("trip_id")).select("user_id", "uri", "trip_id")


@query
def trip_summaries(spark, sf):
    p = photo_ops.trips(a.photos(spark, sf).drop("trip_id"))
    s = photo_ops.trip_summaries(p)
    return s.select("user_id", "trip_id", "first", "last", "photos", "place")


@query
def nearest_place(spark, sf):
    places = a.table(spark, sf, "customer").select(F.col("c_name").alias("name"), (10 + (F.col("c_custkey") % 200) * 0.06).alias("lat"), (70 + (F.col("c_custkey") % 150) * 0.055).alias("lon"), (F.col("c_custkey") * 100).alias("population"))
    found = photo_ops.nearest_places(a.photos(spark, sf).select("id", "lat", "lon"), places)
    return found.select("id", "place", F.round("km", 6).alias("km"))


@query
def gate_verdict(spark, sf):
    sims = photo_ops.similarities(a.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), a.labels(spark, sf))
    g = photo_ops.gate(sims)
    return g.select("id", "label", "is_document", "uncertain", F.round("margin", 6).alias("margin"))


@query
def photo_categories(spark, sf):
    v = a.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    p = photo_ops.category_probabilities(photo_ops.similarities(v, a.labels(spark, sf)), scale=8.0)
    i = F.col("id")
    rows = v.select("id", (i % 13 == 0).alias("saved"), F.when(i % 2 == 0, "UTILITY_BILL").otherwise("PAN").alias("saved_type"), F.lit(0.7).alias("saved_confidence"), F.when(i % 11 == 0, "x/Screenshots/y").otherwise("DCIM").alias("path"), (i % 5 - 1).alias("faces"))
    return photo_ops.decide(rows, p).select("id", "category", F.round("confidence", 6).alias("confidence"))


# ---- duplicates

@query
def exact_duplicates(spark, sf):
    return dedup.exact_duplicates(a.vault(spark, sf), content=F.col("ocr_text"))


@query
def near_dup_text(spark, sf):
    return dedup.similar_texts(a.vault(spark, sf), text=F.col("ocr_text")).withColumn("similarity", F.round("similarity", 9))


@query
def near_dup_classes(spark, sf):
    return dedup.word_set_classes(a.vault(spark, sf), text=F.col("ocr_text"))


@query
def near_dup_vector(spark, sf):
    v = a.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    # the limit holds for the rounded cosine: pairs that reach it only by rounding are found, too
    return dedup.similar_vectors(v, least=0.35 - 1e-6).withColumn("cosine", F.round("cosine", 6)).filter("cosine >= 0.35")


@query
def near_duplicates(spark, sf):
    """The cascade: close vectors, then words, then the best earlier match. Documents that begin alike get nearly one vector."""
    e = a.table(spark, sf, "embeddings").select("vec_id", "embedding")
    begin = sum((F.ascii(F.substring("text", k, 1)) * (31 * k * k + 7) for k in range(1, 9)), F.lit(0))
    d = a.table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    v = d.select("id", (begin % F.lit(e.count())).alias("vec_id")).join(e, "vec_id")
    bent = F.transform("embedding", lambda x, i: x.cast("double") + ((F.col("id") + i) % 3 - 1) * 0.025)
    # divided by its length, which is worked out once for all components
    unit = lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.transform(b, lambda x: x / F.sqrt(s)))
    found = dedup.near_duplicates(d.select("id", "text"), vectors=v.select("id", F.transform(F.array(bent), unit)[0].alias("vector")))
    return found.select("id", "dup_of", F.round("cosine", 6).alias("cosine"))


# ---- search

def _queries(spark, sf):
    return a.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, sf):
    docs = a.vault(spark, sf).select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), "ocr_text", "display_title")
    return stored(search.postings(spread(docs), text=F.col("ocr_text"), title=F.col("display_title")), "postings")


@query
def keyword_hits(spark, sf):
    found = search.keyword_counts(_index(spark, sf), search.terms_of(_queries(spark, sf), text=F.col("text")))
    return found.groupBy("query_id").agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"))


@query
def keyword_bm25(spark, sf):
    found = search.bm25(_index(spark, sf), search.terms_of(_queries(spark, sf), text=F.col("text")), k=10)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _vector_queries(spark, sf):
    return a.table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query
def vector_topk(spark, sf):
    found = search.vector_search(a.vectors(spark, sf), _vector_queries(spark, sf))
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def best_chunk_per_doc(spark, sf):
    return search.best_chunks(a.vectors(spark, sf), _vector_queries(spark, sf)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query
def rrf_fusion(spark, sf):
    d = a.vault(spark, sf)
    by = lambda *c: d.select(F.lit(1).alias("query_id"), F.col("id").alias("doc_id"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*c, "id")).alias("rank")).filter("rank <= 50")
    fused = search.rrf([by(F.desc("effective_date")), by(F.desc("doc_type_confidence")), by(F.desc("needs_llm"))])
    return fused.select("doc_id", F.round("score", 9).alias("score"), "rank")


@query
def hybrid_search(spark, sf):
    """Keyword, vector and type rankings, fused and filtered: the six best documents for every benchmark passage."""
    q = _queries(spark, sf)
    keyword = stored(search.bm25(_index(spark, sf), search.terms_of(q, text=F.col("text")), k=50), "keyword")
    vec = a.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(q.select("query_id"), "query_id", "left_semi")
    meaning = stored(search.vector_search(a.vectors(spark, sf), vec, k=50), "meaning")
    asked = q.filter("query_id % 4 = 1").select("query_id", F.element_at(F.lit(dims.NAMES), (F.col("query_id") % 27 + 1).cast("int")).alias("doc_type"))
    docs = a.vault(spark, sf).select("id", "effective_type", "effective_date", "owner_name")
    typed = search.by_type(docs, asked)
    ruled_out = q.select("query_id", F.lit("TICKET").alias("doc_type"))
    hits = search.hybrid(keyword, meaning, typed, docs, types=asked, excluded_types=ruled_out, owner=vault.owned_by(F.col("owner_name"), "src"), limit=6)
    return hits.select("query_id", "id", F.round("score", 9).alias("score"), F.round("cosine", 6).alias("cosine"), "keyword", "rank")


# ---- text, entities, classification

@query
def script_sets(spark, sf):
    return a.vault(spark, sf).select("id", F.array_join(text.scripts(F.col("ocr_text")), ",").alias("scripts"))


@query
def language_hint_score(spark, sf):
    words = F.filter(F.split(F.lower("text"), text.SEPARATORS), lambda w: w != "")
    hints = {k: {w: str(x) for w, x in v.items()} for k, v in Lexicon().language_hints.items()}
    score = lambda k: F.aggregate(F.transform(F.col("w"), lambda w: F.coalesce(dims.lookup(w, hints[k]).cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return a.table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w")).select("conv_id", "turn", score("te").alias("te"), score("hi").alias("hi"))


@query
def keyword_scores(spark, sf):
    return classify.score_table(spread(a.vault(spark, sf).select("id", "ocr_text")), text=F.col("ocr_text"))


@query
def classify_docs(spark, sf):
    d = spread(a.vault(spark, sf).select("id", "ocr_text")).select("id", "ocr_text", F.array().cast("array<string>").alias("kinds"))
    c = classify.classify(d, text=F.col("ocr_text"), kinds=F.col("kinds"))
    return c.select("id", "doc_type", F.round("doc_type_confidence", 6).alias("confidence"), "needs_model")


@query
def classify_with_hints(spark, sf):
    d = a.vault(spark, sf)
    found = entities.extract(d, text=F.col("ocr_text")).groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    d = d.select("id", "ocr_text").join(found, "id", "left").withColumn("hints", F.create_map(F.lit("a salary slip"), F.lit(0.9)))
    return classify.classify(d, text=F.col("ocr_text"), kinds=F.col("kinds"), hints=F.col("hints")).drop("ocr_text", "kinds", "hints")


@query
def entities_all(spark, sf):
    return entities.extract(a.vault(spark, sf), text=F.col("ocr_text"))


@query
def phone_entities(spark, sf):
    found = a.vault(spark, sf).select("id", F.explode(entities.phones(F.col("ocr_text"))).alias("phone"))
    return found.groupBy("id", "phone").agg(F.count("*").alias("n"))


@query
def amount_max(spark, sf):
    return entities.largest_amount(entities.extract(a.vault(spark, sf), text=F.col("ocr_text")))


def _written(spark, sf):
    """Orders as texts with identifiers, an amount, an account of health and a telephone number."""
    k = F.col("o_orderkey")
    text = F.format_string("PAN ABCDE%04dF, total amount: %d.50 or Rs. %d\npolicy no: AB/%06d-X IFSC SBIN0%06d uid 2341 2341 %04d\nAP 09 AB %04d, call +91 9%04d %05d, mail u%06d@abdm", k % 10000, 1000 + k, 500 + k % 7, k % 1000000, k % 1000000, 2340 + k % 10, k % 10000, k % 10000, k % 100000, k % 1000000)
    return a.table(spark, sf, "orders").select(k.alias("id"), text.alias("t"))


@query
def entities_of_orders(spark, sf):
    return entities.extract(_written(spark, sf), text=F.col("t")).select("id", "kind", "value", "masked")


@query
def amount_max_of_orders(spark, sf):
    return entities.largest_amount(entities.extract(_written(spark, sf), text=F.col("t")))


@query
def phones_of_orders(spark, sf):
    return _written(spark, sf).select("id", F.explode(entities.phones(F.col("t"))).alias("phone"))


@query
def masked_orders(spark, sf):
    return _written(spark, sf).select("id", ids.mask_aadhaar_in(F.col("t")).alias("text"))


def _dated(spark, sf):
    """Orders as policies in five ways of writing dates, with foreign digits in one."""
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    until = F.add_months(on, 480)
    foreign = F.translate(F.date_format(on, "dd/MM/yyyy"), "0123456789", "०१२३४५६७८९")
    way = F.when(k % 4 == 0, F.date_format(on, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(on, "d MMMM yyyy")).when(k % 4 == 2, F.date_format(on, "yyyy-MM-dd")).otherwise(foreign)
    text = F.concat(F.lit("Policy document\nDate of issue: "), way, F.lit("\nsum insured 500\nvalid till "), F.date_format(until, "dd-MM-yyyy"), F.lit("\nthank you"))
    return a.table(spark, sf, "orders").select(k.alias("id"), F.lit("HEALTH_INSURANCE").alias("doc_type"), text.alias("text"))


@query
def dates_of_orders(spark, sf):
    return dates.extract(_dated(spark, sf), TODAY).select("id", "line", "date", "precision")


@query
def expiry_of_orders(spark, sf):
    return dates.pick(_dated(spark, sf), TODAY).select("id", "expiry_on", "expiry_source", "issued_on")


@query
def owners_of_customers(spark, sf):
    """Labelled names, somebody else's names, names in addresses: the owner, or null."""
    c = a.table(spark, sf, "customer").join(a.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    head = F.element_at(F.lit(["Employee Name: MR. ", "Father's Name: ", "Name\n", "Address: near\nInsured name - "]), (F.col("c_custkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("Pay slip\n"), head, F.translate(F.lower("n_name"), "_0123456789", " abcdefghij"), F.lit(" dob 1\nNet pay 5"))
    return c.select("c_custkey", owners.owner(text, F.lit("SALARY_SLIP")).alias("owner"))


@query
def verhoeff_valid(spark, sf):
    n = F.lpad(F.col("l_orderkey").cast("string"), 8, "7")
    rows = a.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(n, F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0")).alias("digits"))
    return rows.select("l_orderkey", "l_linenumber", "digits", ids.verhoeff_valid(F.col("digits")).alias("valid"))


@query
def mask_ids(spark, sf):
    return a.table(spark, sf, "customer").select("c_custkey", ids.mask_last4(F.col("c_name")).alias("masked"))


@query
def masked_texts(spark, sf):
    return a.vault(spark, sf).select("id", F.sha2(ids.mask_aadhaar_in(F.col("ocr_text")), 256).alias("sha256"))


@query
def date_entities(spark, sf):
    return dates.extract(a.vault(spark, sf).select("id", F.col("ocr_text").alias("text")), TODAY)


@query
def expiry_pick(spark, sf):
    return dates.pick(a.vault(spark, sf).select("id", "doc_type", F.col("ocr_text").alias("text")), TODAY)


@query
def owner_names(spark, sf):
    return a.vault(spark, sf).select("id", owners.owner(F.col("ocr_text"), F.col("doc_type")).alias("owner"))


@query
def titles(spark, sf):
    d = a.vault(spark, sf)
    return d.select("id", answers.title(F.col("effective_type"), F.col("owner_name"), F.col("effective_date"), F.col("expiry_on"), F.lit(None).cast("string")).alias("title"))


@query
def chunk_documents(spark, sf):
    d = a.vault(spark, sf).select("id", "ocr_text", "title_en", dims.label_of(F.col("doc_type")).alias("label"))
    return chunks.document_chunks(d, text="ocr_text", facts="title_en", label="label")


# ---- checklists, reminders

def _items(spark):
    return dims.templates(spark).filter("template = 'home_loan'")


def _judged(spark, sf):
    return checklist.candidates(_items(spark), a.checklist_docs(spark, sf), a.day(a.ORDERS_TODAY))


@query
def checklist_found(spark, sf):
    return _judged(spark, sf).filter("verdict in ('found', 'same_month', 'extra')").select("owner", "position", "id", "verdict")


@query
def checklist_status(spark, sf):
    owners_ = a.table(spark, sf, "customer").select(F.col("c_name").alias("owner"))
    return checklist.statuses(_judged(spark, sf), _items(spark), owners_).select("owner", "position", "doc_type", "found", "status")


@query
def pack_order(spark, sf):
    return checklist.pack(_judged(spark, sf)).select("owner", "place", "id")


@query
def renewal_templates(spark, sf):
    return a.vault(spark, sf).filter("expiry_on is not null").select("id", dims.renewal_template(F.col("effective_type")).alias("template"))


@query
def reminders(spark, sf):
    r = checklist.reminders(a.vault(spark, sf), F.lit("2025-01-31 09:00:00").cast("timestamp"))
    return r.select("doc_id", "offset_days", F.to_date("fire_at").alias("fire_on"), "state")


# ---- messages

def _turns(spark, sf):
    return spread(a.table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text"))


@query
def parse_intents(spark, sf):
    p = intents.parse(_turns(spark, sf), Lexicon(), TODAY)
    i = F.col("intent")
    return p.select("conv_id", "turn", i["kind"].alias("kind"), i["template"].alias("template"), F.array_join(i["doc_types"], ",").alias("doc_types"), i["language"].alias("language"), i["confident"].alias("confident"), "correction", "chat_kind")


@query
def route_kinds(spark, sf):
    """Messages by the branch that answers them, with the reply of those that need no search."""
    p = intents.parse(_turns(spark, sf), Lexicon(), TODAY)
    branch = F.when(F.col("correction"), "correction").otherwise(F.col("intent.kind"))
    reply = F.when(branch == "chat", answers.chat_reply(F.col("chat_kind")))
    return p.select(branch.alias("branch"), reply.alias("reply")).groupBy("branch", "reply").agg(F.count("*").alias("n"))


@query
def turn_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag(F.struct("turn", "role")).over(w)
    c = a.table(spark, sf, "conversations").select("conv_id", "turn", before.alias("b"))
    return c.select("conv_id", "turn", F.coalesce(F.col("b.turn"), F.lit(-1)).alias("last_turn"), F.col("b.role").alias("last_role"))


@query
def ordinal_pick(spark, sf):
    """Of the types a conversation has shown, in order, the second and the last."""
    c = a.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x")).withColumn("shown", F.transform("x", lambda t: t["role"]))
    cue = lambda n: F.struct(F.lit(n).alias("ordinal"))
    return c.select("conv_id", intents.picked_document(cue(1), F.col("shown")).alias("second"), intents.picked_document(cue(-1), F.col("shown")).alias("last"))


@query
def follow_ups(spark, sf):
    p = intents.parse(_turns(spark, sf), Lexicon(), TODAY).withColumn("types", F.array(F.lit("PAN")))
    shown = F.array(F.struct(F.lit("PAN").alias("doc_type"), F.lit("Asha").alias("owner_name")))
    return p.select("conv_id", "turn", intents.follow_up(F.col("cue"), F.col("intent"), shown, F.col("types")).alias("plan"), intents.described(F.col("text"), shown).alias("context"))


@query
def validated_replies(spark, sf):
    """A model's replies, here made of the fixture's rows: wrapped JSON, swapped dates, unknown kinds."""
    kind = F.element_at(F.lit(["find", "photos", "chat", "question", "nonsense"]), (F.col("conv_id") % 5 + 1).cast("int"))
    reply = F.format_string('Sure: {"intent": "%s", "doc_types": ["pan", "x"], "date_from": "2025-02-01", "date_to": "2025-01-01", "list_all": false} done', kind)
    r = _turns(spark, sf).select("conv_id", "turn", reply.alias("reply"), F.col("text").alias("message"), F.lit("en").alias("language"))
    v = intents.validated(r)
    i = F.col("intent")
    return v.select("conv_id", "turn", i["kind"].alias("kind"), F.array_join(i["doc_types"], ",").alias("doc_types"), F.array_join(i["dropped"], ",").alias("dropped"), i["date_from"].alias("date_from"), i["date_to"].alias("date_to"), F.col("error").isNotNull().alias("retry"))


@query
def owner_relations(spark, sf):
    known = F.create_map(F.lit("father"), F.lit("Ravi"), F.lit("self"), F.lit("Asha"))
    said = F.concat(F.element_at(F.lit(["my father's ", "my ", "mother's ", "the sonnet of "]), (F.col("doc_id") % 4 + 1).cast("int")), F.col("source"))
    return a.table(spark, sf, "documents").select("doc_id", owners.relation_of(said, known).alias("owner"))


@query
def answer_summaries(spark, sf):
    d = a.vault(spark, sf).groupBy("effective_type").agg(F.count("*").alias("total"), F.array_sort(F.collect_set("owner_name")).alias("owners"))
    shown = F.array_repeat(F.col("effective_type"), 2)
    said = answers.summary(F.array("effective_type"), shown, F.col("total"), F.slice("owners", 1, 2), F.lit("latest"), F.lit("share"))
    return d.select("effective_type", said.alias("answer"))


@query
def citations_kept(spark, sf):
    kept, dropped = answers.citations(F.array("doc_id", F.col("doc_id") + 1, F.lit(7), F.col("doc_id")), F.array("doc_id", F.lit(7).cast("long")))
    return a.table(spark, sf, "documents").select("doc_id", F.array_join(kept, ",").alias("kept"), F.array_join(dropped, ",").alias("dropped"))


# ---- streaming

@query
def stream_ingest_counts(spark, sf):
    """The events as a stream of items, ingested to its end; then the states by status."""
    base = f"{shared_dir(spark)}/papertrail-stream-{uuid.uuid4().hex}"
    a.index_state(spark, sf).select("uri", "generation", "status").write.parquet(f"{base}/in")
    stream = ingest.items(spark, f"{base}/in", "uri string, generation long, status string")
    ingest.run(stream, lambda b: b.withColumn("error", F.when(F.col("status") == "failed", "unreadable")), f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return ingest.status_counts(ingest.states(spark, f"{base}/state"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | MORE
