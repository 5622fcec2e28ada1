"""Photos: is it a document, which category, which trip, which place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail import dims
from papertrail.functions.geo import cell, day_bucket, haversine_km
from papertrail.functions.vectors import dot

PERSONS = ["selfie", "people"]
MIN_CONFIDENCE, FACE_CHECK, GROUP_FACES = 0.4, 0.25, 3
HOME_CELL, AWAY_KM, GAP_MS, TRIP_PHOTOS = 0.05, 40.0, 36 * 3_600_000, 3
PLACE_CELL, PLACE_KM, KM_PER_DEGREE = 0.3, 30.0, 111.0


def similarities(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, ..., sim): each image with every label vector; labels are a dimension of some dozens, and broadcast."""
    every = images.select("id", "vector").crossJoin(F.broadcast(labels.withColumnRenamed("vector", "_v")))
    return every.withColumn("sim", dot(F.col("vector"), F.col("_v"))).drop("vector", "_v")


def gate(sims: DataFrame, *, margin: float = 0.0, band: float = 0.02, scale: float = 1.0) -> DataFrame:
    """(id, label, is_document, uncertain, margin) from sims with the label's is_document: the document gate."""
    g = sims.groupBy("id").agg(F.max_by(F.struct("label", "is_document"), F.struct(F.round("sim", 9), -F.col("ordinal"))).alias("top"), F.max(F.when(F.col("is_document"), F.col("sim"))).alias("doc"), F.max(F.when(~F.col("is_document"), F.col("sim"))).alias("non"))
    m = F.col("doc") - F.coalesce("non", F.lit(-1.0))
    ok = F.col("top.is_document") & (m >= margin)
    return g.select("id", F.col("top.label").alias("label"), F.coalesce(ok, F.lit(False)).alias("is_document"), F.coalesce(F.abs(m - margin) < band, F.lit(False)).alias("uncertain"), m.alias("margin"))


def label_probabilities(sims: DataFrame, *, scale: float = 1.0, only: Column | None = None) -> DataFrame:
    """(id, label, p): softmax over an image's labels, or those named."""
    rows = sims if only is None else sims.filter(only)
    w = Window.partitionBy("id")
    e = rows.withColumn("_e", F.exp(F.lit(scale) * (F.col("sim") - F.max("sim").over(w))))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def category_probabilities(sims: DataFrame, *, scale: float = 1.0) -> DataFrame:
    """(id, category, p): softmax over all labels, summed by category."""
    return label_probabilities(sims, scale=scale).groupBy("id", "category").agg(F.sum("p").alias("p"))


def decide(photos: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(id, category, confidence) for photos (id, saved, saved_type, saved_confidence, path, faces): the filing ladder.

    faces is null or negative where they weren't counted. Ties: the order of categories.
    """
    place = dims.lookup(F.col("category"), {c: f"{i:02d}" for i, c in enumerate(dims.PHOTO_CATEGORIES)}, "99")
    best = lambda ok: F.max_by(F.when(ok, F.struct("category", "p")), F.when(ok, F.struct(F.round("p", 9), F.translate(place, "0123456789", "9876543210"))))
    person = F.col("category").isin(PERSONS)
    g = probabilities.groupBy("id").agg(best(F.lit(True)).alias("best"), best(~person).alias("other"), best(person).alias("who"), F.sum(F.when(person, F.col("p")).otherwise(0.0)).alias("person"))
    x = photos.join(g, "id", "left")
    counted = F.coalesce(F.col("faces") >= 0, F.lit(False))
    c = lambda kind, conf: F.struct(kind.alias("category"), conf.cast("double").alias("confidence"))
    rest = F.when(F.col("person") < 1, F.col("other.p") / (1 - F.col("person"))).otherwise(0.0)
    picked = F.when(~F.col("best.category").isin(PERSONS) | ~counted, c(F.col("best.category"), F.col("best.p"))).when(F.col("faces") == 0, c(F.col("other.category"), rest)).when(F.col("faces") >= GROUP_FACES, c(F.lit("people"), F.col("person"))).otherwise(c(F.col("best.category"), F.col("person")))
    x = x.withColumn("_p", picked)
    unsure = (F.col("_p.category") == "documents") | (F.col("_p.confidence") < MIN_CONFIDENCE)
    bill = F.coalesce(F.col("saved_type").isin(dims.BILLS), F.lit(False))
    done = (
        F.when(F.col("saved"), F.when(bill, c(F.lit("bills"), F.col("saved_confidence"))).otherwise(c(F.lit("documents"), F.lit(1.0))))
        .when(F.coalesce(F.contains(F.lower("path"), F.lit("screenshot")), F.lit(False)), c(F.lit("screenshot"), F.lit(1.0)))
        .when(F.col("best").isNull(), c(F.lit("other"), F.lit(0.0)))
        .when(unsure, c(F.lit("other"), F.col("_p.confidence")))
        .otherwise(F.col("_p"))
    )
    return x.withColumn("_d", done).select("id", F.col("_d.category").alias("category"), F.col("_d.confidence").alias("confidence"))


def needs_face_check(probabilities: DataFrame) -> DataFrame:
    """(id): photos in which counting faces may change the category."""
    own = probabilities.filter(F.col("category").isin(PERSONS)).groupBy("id").agg(F.sum("p").alias("p"))
    return own.filter(F.col("p") >= FACE_CHECK).select("id")


def located(points: DataFrame) -> DataFrame:
    """Points with a place on the map; (0, 0) is none."""
    return points.filter("lat is not null and lon is not null and not (lat = 0 and lon = 0)")


def home_cells(points: DataFrame, *, by: str = "user_id") -> DataFrame:
    """(user, lat, lon, days, photos): where most days were spent, then most photos; its centre is the photos' mean."""
    cells = located(points).withColumn("c", cell(F.col("lat"), F.col("lon"), HOME_CELL))
    n = cells.groupBy(by, "c").agg(F.countDistinct(day_bucket(F.col("taken_at"))).alias("days"), F.count("*").alias("photos"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    best = F.max_by(F.struct("lat", "lon", "days", "photos"), F.struct(F.col("days") * 10_000 + F.col("photos"), -F.col("c.y"), -F.col("c.x")))
    return n.groupBy(by).agg(best.alias("h")).select(by, F.col("h.lat").alias("home_lat"), F.col("h.lon").alias("home_lon"), "h.days", "h.photos")


def trips(points: DataFrame, *, by: str = "user_id", uri: str = "uri") -> DataFrame:
    """points with trip_id where they belong to a trip: over 40 km from home, gaps of at most 36 hours, three photos or more.

    A trip's id is the time of its first photo. Users with fewer than three located photos have none.
    """
    own = located(points)
    enough = own.groupBy(by).agg(F.count("*").alias("n")).filter("n >= 3").select(by)
    away = own.join(home_cells(points, by=by).select(by, "home_lat", "home_lon"), by).join(enough, by, "left_semi")
    away = away.filter(haversine_km(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) > AWAY_KM)
    order = Window.partitionBy(by).orderBy("taken_at", uri)
    gap = F.col("taken_at") - F.lag("taken_at").over(order)
    numbered = away.withColumn("_new", (gap.isNull() | (gap > GAP_MS)).cast("int")).withColumn("_trip", F.sum("_new").over(order))
    whole = Window.partitionBy(by, "_trip")
    kept = numbered.withColumns({"_n": F.count("*").over(whole), "trip_id": F.min("taken_at").over(whole)}).filter(F.col("_n") >= TRIP_PHOTOS)
    return kept.select(*points.columns, "trip_id")


def trip_summaries(photos: DataFrame, *, by: str = "user_id") -> DataFrame:
    """(user, trip_id, first, last, photos, place): a trip's place is its most frequent one, the first by name if two are."""
    places = photos.filter("place is not null").groupBy(by, "trip_id", "place").agg(F.count("*").alias("n"))
    ranked = places.withColumn("_r", F.row_number().over(Window.partitionBy(by, "trip_id").orderBy(F.desc("n"), "place"))).filter("_r = 1")
    spans = photos.filter("trip_id is not null").groupBy(by, "trip_id").agg(F.min("taken_at").alias("first"), F.max("taken_at").alias("last"), F.count("*").alias("photos"))
    return spans.join(ranked.select(by, "trip_id", "place"), [by, "trip_id"], "left")


def trip_label(first: Column, last: Column) -> Column:
    """One day, or two with a dash."""
    day = lambda c: F.date_format(F.timestamp_millis(c), "d MMM yyyy")
    return F.when(day(first) == day(last), day(first)).otherwise(F.concat(day(first), F.lit(" – "), day(last)))


def nearest_places(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place, km): for points (id, lat, lon) the place within 30 km with the least km - 3 log10(population).

    Places, of which there are fewer, are filed in all cells that 30 km around them reach into: three rows of cells, of
    which more are needed the nearer the poles are. Points look into their own cell only, and each distinct point once.
    """
    at = located(points).select("lat", "lon").distinct().withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    asked = at.withColumn("_c", cell(F.col("_lat"), F.col("_lon"), PLACE_CELL)).select("_lat", "_lon", "_c.y", "_c.x")
    narrow = F.cos(F.radians(F.least(F.abs("lat") + PLACE_CELL, F.lit(89.0))))
    wide = F.ceil(F.lit(PLACE_KM / KM_PER_DEGREE / PLACE_CELL) / narrow).cast("int")
    rows, columns = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))), F.explode(F.sequence(-F.col("_w"), F.col("_w")))
    filed = places.select("name", "lat", "lon", "population", wide.alias("_w"), rows.alias("_dy")).select("*", columns.alias("_dx"))
    filed = filed.withColumn("_c", cell(F.col("lat"), F.col("lon"), PLACE_CELL)).select("name", "lat", "lon", "population", (F.col("_c.y") + F.col("_dy")).alias("y"), (F.col("_c.x") + F.col("_dx")).alias("x"))
    near = asked.join(filed, ["y", "x"]).withColumn("km", haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).filter(F.col("km") <= PLACE_KM)
    rated = near.withColumn("rating", F.col("km") - 3 * F.log10(F.greatest(F.col("population"), F.lit(1)).cast("double")))
    best = rated.groupBy("_lat", "_lon").agg(F.min_by(F.struct("name", "km"), F.struct(F.round("rating", 9), "name")).alias("b"))
    found = points.join(best, (points["lat"] == best["_lat"]) & (points["lon"] == best["_lon"]))
    return found.select("id", F.col("b.name").alias("place"), "b.km")


def trip_photos_first(in_trips: DataFrame, own: DataFrame, *, most: int = 60) -> DataFrame:
    """Photos of trips, newest first, then those of the category, each once, the first sixty."""
    every = in_trips.select("uri", "taken_at", F.lit(0).alias("list")).unionByName(own.select("uri", "taken_at", F.lit(1).alias("list")))
    first = every.groupBy("uri").agg(F.min(F.struct("list", (-F.col("taken_at")).alias("at"))).alias("k"), F.first("taken_at").alias("taken_at"))
    return first.orderBy("k", "uri").limit(most).select("uri", "taken_at", F.col("k.list").alias("list"))


def resync(photos: DataFrame, docs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(id, category, confidence) of photos whose category changes when the documents kept change."""
    saved = docs.select(F.col("id").alias("doc_id"), F.col("effective_type").alias("saved_type"), F.col("doc_type_confidence").alias("saved_confidence"), F.lit(True).alias("saved"))
    now = photos.drop("saved", "saved_type", "saved_confidence").join(saved, "doc_id", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    new = decide(now, probabilities)
    was = photos.select("id", F.col("category").alias("was"))
    return new.join(was, "id").filter("category <> was").drop("was")


def resync_changed(photos: DataFrame, changes: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(id, category, confidence) of photos (id, doc_id, category, path, faces) whose category changes with the documents
    in changes (doc_id, saved, saved_type, saved_confidence: what is kept of each now; saved is false if it is gone).

    Only photos of changed documents, and only their probabilities, are looked at: the rest can't have changed.
    """
    touched = photos.drop("saved", "saved_type", "saved_confidence").join(changes, "doc_id")
    new = decide(touched, probabilities.join(touched.select("id"), "id", "left_semi"))
    return new.join(touched.select("id", F.col("category").alias("was")), "id").filter("category <> was").drop("was")
