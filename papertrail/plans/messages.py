"""Queries over messages: what they ask for, how they relate to the reply before, which branch answers them and with what.

The turns of the fixture's users say phrases of a list, chosen by conversation and turn; what each phrase means is written
down here by hand, and is what the SQL answers with.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail import dims
from papertrail.lexicon import Lexicon
from papertrail.operators import answers, intents, router, search, terms
from papertrail.plans import adapters as a
from papertrail.plans.registry import oracle, query
from papertrail.plans.sql import _BM25, _LABEL_OF, _STOP, _TERMS, _ranked
from papertrail.storage import spread, stored

TODAY = dt.date(2026, 9, 27)


class Said(NamedTuple):
    """A phrase and its meaning. plan, nth: how it relates to a reply that showed two salary slips, and which it points at."""

    text: str
    kind: str = "find"
    types: str = ""
    excluded: str = ""
    action: str | None = None
    list_all: bool = False
    oldest: bool = False
    template: str | None = None
    photo: str | None = None
    first: str | None = None
    last: str | None = None
    language: str = "en"
    chat: str | None = None
    correction: bool = False
    plan: str | None = None
    nth: int | None = None


PHRASES = [
    Said("show my salary slips", types="SALARY_SLIP"),
    Said("hi", "chat", chat="greeting"),
    Said("thank you so much", "chat", chat="thanks"),
    Said("नमस्ते", "chat", language="hi", chat="greeting"),
    Said("ధన్యవాదాలు", "chat", language="te", chat="thanks"),
    Said("who are you", "chat", chat="help"),
    Said("bye", "chat", chat="bye"),
    Said("what's the weather today", "chat", chat="offtopic"),
    Said("is my data safe", "chat", chat="privacy"),
    Said("yes", "chat", chat="thanks"),
    Said("how do I apply", "chat", action="advice"),
    Said("hi, show my aadhaar", types="AADHAAR", chat="greeting"),
    Said("show my pan", types="PAN"),
    Said("latest salary slip", types="SALARY_SLIP"),
    Said("oldest salary slip", types="SALARY_SLIP", oldest=True),
    Said("how many salary slips do I have", types="SALARY_SLIP"),
    Said("do I have a passport?", types="PASSPORT"),
    Said("I need my car insurance papers", types="VEHICLE_INSURANCE"),
    Said("send my resume as pdf", types="RESUME", action="share"),
    Said("mera aadhaar dikhao", types="AADHAAR", language="hi"),
    Said("नेरा पैन", types="PAN", language="hi"),
    Said("నా ఆధార్ కార్డ్ చూపించు", types="AADHAAR", language="te"),
    Said("show all documents except aadhaar", excluded="AADHAAR", list_all=True),
    Said("anything other than bills", excluded="RECEIPT_INVOICE", list_all=True),
    Said("not my pan, my aadhaar", types="AADHAAR", excluded="PAN"),
    Said("what documents do I have", list_all=True),
    Said("show everything", list_all=True),
    Said("this is not the salary slip", types="SALARY_SLIP", correction=True, plan="show"),
    Said("wrong one", correction=True),
    Said("none of these", correction=True, plan="show"),
    Said("galat hai", correction=True),
    Said("no", correction=True),
    Said("I have no passport", types="PASSPORT"),
    Said("delete my aadhaar", types="AADHAAR", action="delete"),
    Said("email my salary slip", types="SALARY_SLIP", action="share"),
    Said("I lost my aadhaar what should I do", types="AADHAAR", action="advice"),
    Said("how to apply for passport", types="PASSPORT", action="advice"),
    Said("salary slip from march", types="SALARY_SLIP", first="2026-03-01", last="2026-03-31"),
    Said("november salary slip", types="SALARY_SLIP", first="2025-11-01", last="2025-11-30"),
    Said("salary slip march 2025", types="SALARY_SLIP", first="2025-03-01", last="2025-03-31"),
    Said("bank statement of 2024", types="BANK_STATEMENT"),
    Said("may I see my pan", types="PAN"),
    Said("what is my car insurance policy number", "question", types="VEHICLE_INSURANCE"),
    Said("when does it expire?", "reminders", plan="ask"),
    Said("what's the total amount?", "question", plan="ask"),
    Said("when does this salary slip expire?", "reminders", types="SALARY_SLIP", plan="ask"),
    Said("the second one", plan="show", nth=2),
    Said("the last one", plan="show", nth=2),
    Said("when was the first one issued?", "question", plan="ask", nth=1),
    Said("delete the first one", action="delete", plan="show", nth=1),
    Said("share it", action="share", plan="show"),
    Said("and my wife's?", plan="again"),
    Said("show another one", plan="again"),
    Said("thanks, anything expiring soon?", "reminders", chat="thanks"),
    Said("home loan documents ready", "pack", template="home_loan"),
    Said("show my trip photos", "photos", photo="places"),
    Said("food pics", "photos", photo="food"),
    Said("selfies from last month", "photos", photo="selfie", first="2026-08-01", last="2026-08-31"),
    Said("pics from nation 7"),
    Said("food photos in nation 12", "photos", photo="food"),
    Said("pan card from nation 3", types="PAN"),
]
_HIDES = {"show another one"}


def said(spark: SparkSession, sf: str) -> DataFrame:
    """The users' turns as messages: query_id, conv_id, turn, text."""
    c = a.table(spark, sf, "conversations").filter("role = 'user'")
    phrase = F.element_at(F.lit([p.text for p in PHRASES]), ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    return spread(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", phrase.alias("text")))


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


_SAID = (
    "phrases(n, " + ", ".join(Said._fields) + ") AS (VALUES " + ", ".join(f"({n}, {', '.join(map(_value, p))})" for n, p in enumerate(PHRASES))
    + f"), said AS (SELECT conv_id * 1000 + turn AS query_id, c.conv_id, c.turn, p.* FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') c JOIN phrases p ON n = (conv_id * 7 + turn) % {len(PHRASES)})"
)


@query
def intents_of_messages(spark, sf):
    """Phrases by the rules: all that is read from them."""
    p = intents.parse(said(spark, sf), Lexicon(), TODAY)
    i = F.col("intent")
    joined = lambda c: F.array_join(i[c], ",").alias("types" if c == "doc_types" else "excluded")
    return p.select("query_id", i["kind"].alias("kind"), joined("doc_types"), joined("exclude_types"), i["action"].alias("action"), i["list_all"].alias("list_all"), (i["order"] == "oldest").alias("oldest"), i["template"].alias("template"), i["photo_category"].alias("photo"), i["date_from"].alias("first"), i["date_to"].alias("last"), i["language"].alias("language"), F.col("chat_kind").alias("chat"), "correction")


oracle(intents_of_messages, f"WITH {_SAID} SELECT query_id, kind, types, excluded, action, list_all, oldest, template, photo, first, last, language, chat, correction FROM said")


def _shown(spark, sf, kind: str) -> DataFrame:
    """What the reply before has shown: the two newest documents of a type (one row)."""
    two = a.vault(spark, sf).filter(F.col("effective_type") == kind).select("id", F.col("effective_type").alias("doc_type"), "owner_name", "effective_date").orderBy(F.desc("effective_date"), "id").limit(2)
    row = F.sort_array(F.collect_list(F.struct((-F.unix_date("effective_date")).alias("o"), "id", "doc_type", "owner_name")))
    return two.agg(F.transform(row, lambda d: F.struct(d["id"].alias("id"), d["doc_type"].alias("doc_type"), d["owner_name"].alias("owner_name"))).alias("shown"))


def _in_context(spark, sf) -> DataFrame:
    """Messages, of which those of every other turn answer a reply with two salary slips."""
    reply = F.broadcast(_shown(spark, sf, "SALARY_SLIP").withColumn("answered", F.lit(True)))  # one row
    m = intents.parse(said(spark, sf), Lexicon(), TODAY).withColumn("answered", F.col("turn") % 4 != 0)
    m = m.join(reply, "answered", "left")
    return m.withColumn("context_types", F.transform("shown", lambda d: d["doc_type"])).withColumn("context_types", F.array_distinct("context_types"))


_REPLY = "two AS (SELECT id, row_number() OVER (ORDER BY effective_date DESC, id) AS r FROM (SELECT id, effective_date FROM vault WHERE effective_type = 'SALARY_SLIP' ORDER BY effective_date DESC, id LIMIT 2)), reply AS (SELECT list(id ORDER BY r) AS ids FROM two)"


@query
def follow_ups_of_messages(spark, sf):
    """How messages relate to the reply before, and which of its documents they mean."""
    p = _in_context(spark, sf)
    plan = intents.follow_up(F.col("cue"), F.col("intent"), F.col("shown"), F.col("context_types"))
    picked = intents.picked_document(F.col("cue"), F.col("shown"))
    return p.select("query_id", plan.alias("plan"), F.when(plan.isNotNull(), picked["id"]).alias("picked"))


oracle(follow_ups_of_messages, a.VAULT + f", {_SAID}, {_REPLY} SELECT query_id, CASE WHEN turn % 4 <> 0 THEN plan END AS plan, CASE WHEN turn % 4 <> 0 AND plan IS NOT NULL THEN ids[nth] END AS picked FROM said, reply")


@query
def routed_messages(spark, sf):
    """Every message answered by its branch, each different ask once: photos, searches, follow-ups, reminders, tasks, talk."""
    m = _in_context(spark, sf)
    photos = a.photos(spark, sf)
    places = terms.places_in(m.select("query_id", "text"), photos.select(F.col("place").alias("name")), by="query_id")
    wanted, _ = router.asks(router.route(m.join(places, "query_id", "left")))
    docs = a.vault(spark, sf).select("id", "ocr_text", "display_title", "effective_type", "effective_date", "expiry_on", "owner_name")
    chunks = docs.select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), "ocr_text", "display_title")
    index = stored(search.postings(spread(chunks), text=F.col("ocr_text"), title=F.col("display_title")), "postings")
    docs = docs.drop("ocr_text", "display_title")
    return router.answered(wanted, docs=docs, photos=photos, find=router.searcher(index, docs))


def _say(key: str) -> str:
    return _value(answers.WORDING[key])


_ASKED = _TERMS.replace("item_id AS query_id", "ask AS query_id").replace("FROM benchmark", "FROM searches")
_KINDS = "[" + ", ".join(f"'{n}'" for n in dims.NAMES) + "]"
oracle(
    routed_messages,
    a.VAULT + ", " + a.PHOTOS.strip().removeprefix("WITH ") + f""", {_SAID}, {_REPLY},
placed0 AS (SELECT *, CASE text WHEN 'pics from nation 7' THEN 'NATION_7' WHEN 'food photos in nation 12' THEN 'NATION_12' WHEN 'pan card from nation 3' THEN 'NATION_3' END AS named, turn % 4 <> 0 AND len(ids) > 0 AS context FROM said, reply),
placed1 AS (SELECT * REPLACE (CASE WHEN named IN (SELECT place FROM photos) THEN named END AS named) FROM placed0),
branched AS (SELECT *, CASE WHEN named IS NOT NULL AND types = '' THEN 'photos' WHEN context AND correction THEN 'find' WHEN context AND plan IS NOT NULL THEN 'follow_up_' || plan ELSE kind END AS branch FROM placed1),
typed0 AS (SELECT *, CASE WHEN context AND (correction OR plan IS NOT NULL) AND types = '' THEN 'SALARY_SLIP' ELSE types END AS t, branch IN ('find', 'question', 'follow_up_again') AS searches,
  context AND (correction OR branch IN ('find', 'question') AND types = 'SALARY_SLIP' OR text = 'show another one') AS hides FROM branched),
plans AS (SELECT query_id, branch, CASE WHEN searches AND NOT list_all THEN text END AS text, CASE WHEN searches AND NOT list_all OR branch = 'reminders' THEN t END AS types, CASE WHEN searches OR branch = 'reminders' THEN excluded END AS excluded,
  CASE WHEN searches AND NOT list_all OR branch = 'photos' THEN first END AS first, CASE WHEN searches AND NOT list_all OR branch = 'photos' THEN last END AS last, searches AND NOT list_all AND oldest AS oldest,
  CASE WHEN searches AND NOT list_all OR branch IN ('follow_up_ask', 'follow_up_show') THEN action END AS action, searches AND list_all AS overview, CASE WHEN branch = 'pack' OR searches THEN template END AS template,
  CASE WHEN branch = 'photos' THEN CASE WHEN named IS NULL THEN photo WHEN photo <> 'places' THEN photo END END AS category, CASE WHEN branch = 'photos' THEN named END AS place, CASE WHEN branch = 'chat' THEN chat END AS chat,
  CASE WHEN searches AND NOT list_all AND hides THEN ids ELSE [] END AS hidden, CASE WHEN branch IN ('follow_up_ask', 'follow_up_show') THEN CASE WHEN nth IS NULL THEN ids ELSE [ids[nth]] END END AS pointed, CASE branch WHEN 'question' THEN 3 ELSE 6 END AS most FROM typed0),
asks AS (SELECT min(query_id) AS ask, count(*) AS messages, * EXCLUDE (query_id) FROM plans GROUP BY ALL),
searches AS (SELECT * FROM asks WHERE branch IN ('find', 'question', 'follow_up_again') AND NOT overview),
""" + _ASKED + _BM25 + _ranked(50, "keyword") + f""",
typed AS (SELECT ask AS query_id, v.id AS doc_id, row_number() OVER (PARTITION BY ask ORDER BY effective_date DESC, v.id) AS rank FROM searches s JOIN vault v ON v.effective_type = s.types),
l AS (SELECT query_id, doc_id, 0 AS list, rank FROM keyword UNION ALL SELECT query_id, doc_id, 2, rank FROM typed),
fused AS (SELECT query_id, doc_id, sum(1 / (60 + rank)) AS score, min((list, rank)) AS first FROM l GROUP BY ALL), f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, doc_id) AS spot FROM fused),
within0 AS (SELECT s.ask, s.oldest, s.most, s.hidden, v.id, v.effective_type, v.effective_date, row_number() OVER (PARTITION BY ask ORDER BY spot) AS spot FROM f JOIN searches s ON ask = query_id JOIN vault v ON v.id = doc_id
  WHERE (s.types = '' OR v.effective_type = s.types) AND v.effective_type <> s.excluded AND (first IS NULL OR effective_date >= first::DATE) AND (last IS NULL OR effective_date <= last::DATE)),
unseen AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY spot) AS w FROM within0 WHERE spot <= 56 AND NOT list_contains(hidden, id)),
found AS (SELECT ask, row_number() OVER (PARTITION BY ask ORDER BY CASE WHEN oldest THEN effective_date END, spot) AS rank, id::VARCHAR AS item, effective_type, most FROM unseen WHERE w <= CASE WHEN oldest THEN 50 ELSE most END),
newest AS (SELECT ask, row_number() OVER (PARTITION BY ask ORDER BY effective_date DESC, id) AS rank, id::VARCHAR AS item, effective_type FROM asks a JOIN vault v ON v.effective_type <> a.excluded WHERE overview),
shots AS (SELECT ask, row_number() OVER (PARTITION BY ask ORDER BY CASE WHEN a.place IS NULL AND a.category = 'places' AND p.trip_id IS NOT NULL THEN 0 ELSE 1 END, taken_at DESC, uri) AS rank, uri AS item FROM asks a JOIN photos p
  ON (CASE WHEN a.place IS NOT NULL THEN p.place = a.place AND (a.category IS NULL OR p.category = a.category) ELSE p.category = a.category OR (a.category = 'places' AND p.trip_id IS NOT NULL) END)
  WHERE branch = 'photos' AND (first IS NULL OR taken_at >= epoch_ms(first::TIMESTAMP)) AND (last IS NULL OR taken_at < epoch_ms(last::TIMESTAMP + INTERVAL 1 DAY))),
hits AS (
  SELECT ask, rank, item, effective_type FROM found WHERE rank <= most UNION ALL SELECT ask, rank, item, effective_type FROM newest WHERE rank <= 6
  UNION ALL SELECT ask, r.i, pointed[r.i]::VARCHAR, 'SALARY_SLIP' FROM asks, range(1, 3) r(i) WHERE pointed IS NOT NULL AND r.i <= len(pointed)
  UNION ALL SELECT ask, row_number() OVER (PARTITION BY ask ORDER BY expiry_on, id), id::VARCHAR, effective_type FROM asks a JOIN vault v ON (a.types = '' OR a.types = v.effective_type) WHERE branch = 'reminders' AND expiry_on IS NOT NULL
  UNION ALL SELECT ask, rank, item, NULL FROM shots WHERE rank <= 60 UNION ALL SELECT ask, 1, template, NULL FROM asks WHERE branch = 'pack'
), shown AS (SELECT ask, count(*) AS n, list(effective_type ORDER BY rank) AS kinds FROM hits WHERE rank <= 6 GROUP BY ask),
match AS (SELECT ask, trim(owner_name) AS owner, count(*) AS n, max(effective_date) AS newest FROM searches s JOIN vault v ON v.effective_type = s.types WHERE (first IS NULL OR effective_date >= first::DATE) AND (last IS NULL OR effective_date <= last::DATE) GROUP BY ALL),
sums AS (SELECT ask, sum(n)::BIGINT AS total, list_slice(list(owner ORDER BY newest DESC, owner) FILTER (owner <> ''), 1, {answers.SHOWN_OWNERS}) AS owners FROM match GROUP BY ask),
tally AS (SELECT ask, effective_type, count(*) AS n FROM asks a JOIN vault v ON v.effective_type <> a.excluded WHERE overview GROUP BY ALL),
tallies AS (SELECT ask, sum(n)::BIGINT AS total, array_to_string(list_slice(list({_LABEL_OF} || ' ' || n ORDER BY n DESC, effective_type), 1, {answers.SHOWN_TYPES}), ', ') AS listed FROM tally GROUP BY ask),
told AS (SELECT a.*, s.n, s.kinds, m.owners, t.listed, CASE WHEN overview THEN coalesce(t.total, 0) WHEN branch IN ('find', 'question', 'follow_up_again') THEN greatest(coalesce(m.total, 0), coalesce(n, 0)) END AS total
  FROM asks a LEFT JOIN shown s USING (ask) LEFT JOIN sums m USING (ask) LEFT JOIN tallies t USING (ask)),
labelled AS (SELECT *, (SELECT string_agg(label, ', ' ORDER BY i) FROM (SELECT {_LABEL_OF} AS label, min(i) AS i FROM (SELECT unnest(kinds) AS effective_type, unnest(range(len(kinds))) AS i) GROUP BY ALL)) AS names, (SELECT {_LABEL_OF} FROM (SELECT types AS effective_type)) AS label, (SELECT {_LABEL_OF} FROM (SELECT excluded AS effective_type)) AS left_out FROM told),
noted AS (SELECT *, branch IN ('find', 'question', 'follow_up_again') AND NOT overview AS sought, CASE action WHEN 'share' THEN {_say('share')} WHEN 'delete' THEN {_say('delete')} WHEN 'edit' THEN {_say('edit')} WHEN 'advice' THEN {_say('advice')} END AS extra,
  CASE WHEN n = 1 THEN 'Found 1 document: ' || names || '.' ELSE 'Found ' || n || ' documents: ' || names || '.' END AS plain FROM labelled)
SELECT ask, branch, messages, CASE WHEN sought AND n IS NULL THEN CASE WHEN len(hidden) > 0 THEN 'no_other' WHEN (branch = 'question' AND types = '') OR (branch <> 'question' AND (action = 'advice' OR (types = '' AND template IS NULL))) THEN 'text_only' END END AS note, total::BIGINT AS total,
  CASE WHEN branch = 'chat' THEN CASE chat WHEN 'greeting' THEN {_say('greeting')} WHEN 'thanks' THEN {_say('thanks')} WHEN 'help' THEN {_say('help')} WHEN 'bye' THEN {_say('bye')} WHEN 'privacy' THEN {_say('privacy')} ELSE {_say('offtopic')} END
   WHEN overview THEN concat_ws(' ', 'You have ' || total || ' documents: ' || listed || '.', 'Left out: ' || left_out || '.')
   WHEN sought AND n IS NULL THEN CASE WHEN len(hidden) > 0 THEN CASE WHEN types <> '' THEN 'There is no other ' || label || ' saved.' ELSE {_say('no_other')} END WHEN action = 'advice' THEN 'No ' || coalesce(label, 'document') || ' is saved, and procedures can''t be looked up here.' WHEN types = '' THEN {_say('unclear')} ELSE {_say('nothing')} END
   WHEN branch IN ('find', 'follow_up_again') THEN concat_ws(' ', CASE WHEN types = '' THEN plain WHEN total <= 1 THEN 'Here is your ' || label || '.' ELSE concat_ws(' ', label || ': ' || total || ' saved' || coalesce(', for ' || array_to_string(owners, ', '), '') || '.', CASE WHEN n < total THEN 'Showing the ' || CASE WHEN oldest THEN 'oldest ' ELSE 'latest ' END || n || '.' END) END, extra)
   WHEN branch = 'follow_up_show' THEN concat_ws(' ', CASE WHEN n <= 1 THEN 'Here is your ' || names || '.' ELSE names || ': ' || n || ' saved.' END, extra) END AS reply, rank, item
FROM noted LEFT JOIN hits USING (ask)
""",
)


# ---- terms of a dictionary, met by joins

@query
def close_terms(spark, sf):
    """Words of conversations that are a slip or two away from a word of the benchmark, or the same."""
    word = lambda t: a.table(spark, sf, t).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).distinct()
    known = word("benchmark").select(F.col("word").alias("term"), terms.allowed_slips(F.col("word")).alias("slips"))
    return terms.close_terms(word("conversations"), known, between=True)


_SWAPPED = "[substr(w.word, 1, i - 1) || substr(w.word, i + 1, 1) || substr(w.word, i, 1) || substr(w.word, i + 2) FOR i IN range(1, length(w.word))]"
oracle(
    close_terms,
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM conversations), t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM benchmark),
k AS (SELECT term, CASE WHEN length(term) >= 8 THEN 2 ELSE 1 END AS slips FROM t WHERE length(term) >= 5),
near AS (SELECT word, term, slips, levenshtein(word, term) AS l, damerau_levenshtein(word, term) AS d FROM w JOIN k ON abs(length(word) - length(term)) <= slips WHERE word <> '')
SELECT word, term, d::INT AS distance FROM near WHERE d <= slips""",
)


@query
def places_of_messages(spark, sf):
    """The place that a message names, of as many places as there are customers: their numbers written as words."""
    names = a.table(spark, sf, "customer").select(F.concat_ws(" ", F.lit("Newtown"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")).alias("name"))
    single = a.table(spark, sf, "customer").select(F.concat(F.lit("Por"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "aeioubcdfg"), F.lit("ville")).alias("name"))
    key = F.col("conv_id") % 200 + 1
    word = F.translate(key.cast("string"), "0123456789", "abcdefghij")
    other = F.translate(key.cast("string"), "0123456789", "aeioubcdfg")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Photos from newtown "), word, F.lit("!"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("what of Por"), other, F.lit("vile's bills"))).otherwise(F.concat(F.lit("newtowns "), word))
    said_ = a.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), text.alias("text"))
    return terms.places_in(said_, names.unionByName(single))


oracle(
    places_of_messages,
    """WITH names AS (SELECT 'Newtown ' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS name FROM customer UNION SELECT 'Por' || translate(c_custkey::VARCHAR, '0123456789', 'aeioubcdfg') || 'ville' FROM customer),
m AS (SELECT conv_id * 1000 + turn AS message_id, (conv_id % 200 + 1)::VARCHAR AS k, turn FROM conversations),
q AS (SELECT DISTINCT message_id, trim(regexp_replace(lower(CASE turn % 3 WHEN 0 THEN 'Photos from newtown ' || translate(k, '0123456789', 'abcdefghij') || '!' WHEN 1 THEN 'what of Por' || translate(k, '0123456789', 'aeioubcdfg') || 'vile''s bills' ELSE 'newtowns ' || translate(k, '0123456789', 'abcdefghij') END), '[^a-z]+', ' ', 'g')) AS q FROM m)
SELECT message_id, arg_min(name, (-length(name), name)) AS place FROM q JOIN names ON contains(' ' || q || ' ', ' ' || lower(name) || ' ') OR (name LIKE 'Por%' AND len([w FOR w IN string_split(q, ' ') IF damerau_levenshtein(regexp_replace(w, 's$', ''), lower(name)) <= 1]) > 0) GROUP BY message_id""",
)
