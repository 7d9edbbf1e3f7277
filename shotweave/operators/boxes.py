"""Detections: boxes, suppression of overlapping ones, candidates of a scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least side of a box, overlaps that clash, and weights of relevance.
SLIVER = 0.004
SAME, GROUP, ANY = 0.5, 0.6, 0.85
FLOOR, SIZE, CENTRE, PERSISTENCE = 0.60, 0.20, 0.08, 0.12


def clamped(detections: DataFrame) -> DataFrame:
    """Boxes inside [0, 1]; slivers go."""
    rows = detections.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in ("x1", "y1", "x2", "y2")})
    return rows.where((F.col("x2") - F.col("x1") > SLIVER) & (F.col("y2") - F.col("y1") > SLIVER))


def area(b: Column | None = None) -> Column:
    get = (lambda c: F.col(c)) if b is None else (lambda c: b[c])
    return F.greatest(F.lit(0.0), get("x2") - get("x1")) * F.greatest(F.lit(0.0), get("y2") - get("y1"))


def iou(a: Column, b: Column) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - width * height
    return F.when(union > 0, width * height / union).otherwise(0.0)


def clash(a: Column, b: Column, same: float = SAME, group: float = GROUP, any_: float = ANY) -> Column:
    """Two detections of one thing: of one type, of competing types of one group, or on nearly the same box."""
    o = iou(a, b)
    return ((a["type_id"] == b["type_id"]) & (o > same)) | ((a["grp"] == b["grp"]) & (a["grp"] != "") & (o > group)) | (o > any_)


BOX = ("det", "type_id", "grp", "score", "x1", "y1", "x2", "y2")


def suppressed(detections: DataFrame, keys: list[str], same: float = SAME, group: float = GROUP, any_: float = ANY) -> DataFrame:
    """Keep the best of clashing detections of a frame (``keys``): strongest first, equal ones by ``det``, each if it
    clashes with none that is kept. A fold over one frame's detections."""
    entry = F.struct((-F.col("score")).alias("key"), *[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "grp" else F.col(c) for c in BOX])
    rows = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("queue"))
    none = F.filter("queue", lambda x: F.lit(False))
    kept = F.aggregate("queue", none, lambda kept, d: F.when(F.exists(kept, lambda k: clash(k, d, same, group, any_)), kept).otherwise(F.concat(kept, F.array(d))))
    return rows.select(*keys, F.inline(kept)).drop("key")


def merged_frames(detections: DataFrame, shot: list[str]) -> DataFrame:
    """One list for a shot from its sampled frames: the same thing seen in two frames is kept once."""
    return suppressed(detections, shot, same=0.3, group=0.5)


def size_score(a: Column) -> Column:
    """Full from 1 % of the frame; fades above 60 %."""
    s = F.least(F.lit(1.0), F.sqrt(a / 0.01))
    fade = F.when(a > 0.6, F.greatest(F.lit(0.3), 1.0 - (a - 0.6) / 0.4 * 0.7)).otherwise(1.0)
    return F.when(a <= 0, 0.0).otherwise(s * fade)


def centre_score(b: Column | None = None) -> Column:
    get = (lambda c: F.col(c)) if b is None else (lambda c: b[c])
    return F.greatest(F.lit(0.0), 1.0 - F.hypot((get("x1") + get("x2")) / 2 - 0.5, (get("y1") + get("y2")) / 2 - 0.5) / 0.7071)


def relevance(base: Column, size: Column, centre: Column, persistence: Column) -> Column:
    """How much a thing's own value shows: between 60 % and all of it. Factors come rounded to 3 places, so exact halves
    are common; a nudge sends them up whatever their last binary digit is."""
    return F.round(base * (FLOOR + SIZE * size + CENTRE * centre + PERSISTENCE * persistence) + 1e-9, 4)


def with_relevance(rows: DataFrame, seen: str) -> DataFrame:
    """Adds size, centrality, persistence and relevance. ``rows``: base, box columns and how often it is seen."""
    rows = rows.withColumn("size", F.round(size_score(area()), 3)).withColumn("centrality", F.round(centre_score(), 3))
    rows = rows.withColumn("persistence", F.round(F.least(F.lit(1.0), F.col(seen) / 3.0), 3))
    return rows.withColumn("relevance", relevance(F.col("base"), F.col("size"), F.col("centrality"), F.col("persistence")))


def hidden_reason(confidence: Column, relevance: Column, tier: Column, floor: float, least: float) -> Column:
    """Why a candidate isn't shown, or null. Confidence counts before relevance."""
    need = F.greatest(F.lit(floor), F.coalesce(tier, F.lit(0.0)))
    return F.when(confidence < need, "low detector confidence").when(relevance < least, "low commercial relevance")


def credited(detections: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each type's occurrences in a scene: a representative's detections count for every repeat of its set-up, once for a
    type and shot (by the first unit). ``detections``: scene, unit, rep_shot, type_id. ``occurrences``: scene, unit, shot,
    start, end. Returns scene, type_id, shot, start, end, unit, detected."""
    rows = detections.select("scene", "unit", "type_id", "rep_shot").distinct().join(occurrences, ["scene", "unit"])
    first = F.min(F.struct("unit", "start", "end", (F.col("shot") == F.col("rep_shot")).alias("detected"))).alias("o")
    return rows.groupBy("scene", "type_id", "shot").agg(first).select("scene", "type_id", "shot", "o.start", "o.end", "o.unit", "o.detected")


def type_groups(detections: DataFrame) -> DataFrame:
    """Detections of one type in a scene: scene, type_id, detections, shots, most in one frame, the best one's columns."""
    entry, key = F.struct("det", "score", "base", "x1", "y1", "x2", "y2"), F.struct("score", "area", -F.col("det"))
    rows = detections.withColumn("area", area()).groupBy("scene", "type_id", "shot")
    rows = rows.agg(F.count(F.lit(1)).alias("in_frame"), F.max(F.struct(key.alias("key"), entry.alias("best"))).alias("b"))
    # A null shot is a frame, but not one of the shots that are seen.
    rows = rows.groupBy("scene", "type_id").agg(F.sum("in_frame").alias("detections"), F.count("shot").alias("seen"), F.max("in_frame").alias("max_instances"), F.max("b").alias("b"))
    return rows.select("scene", "type_id", "detections", "seen", "max_instances", "b.best.*")


def candidates(detections: DataFrame, tiers: DataFrame, floor: float, least: float) -> DataFrame:
    """Ranked candidates of each scene: shown ones first, then by relevance times confidence: adds relevance,
    hidden_reason, displayed, place. ``tiers``: type_id, tier."""
    few = tiers.limit(MOST_PROMPTS + 1).count() <= MOST_PROMPTS
    rows = with_relevance(type_groups(detections), "seen").join(F.broadcast(tiers) if few else tiers, "type_id", "left")
    rows = rows.withColumn("hidden_reason", hidden_reason(F.col("score"), F.col("relevance"), F.col("tier"), floor, least))
    rows = rows.withColumn("displayed", F.col("hidden_reason").isNull())
    # As it is told: by the confidence to 4 places.
    order = Window.partitionBy("scene").orderBy(F.desc("displayed"), F.desc(F.round(F.col("relevance") * F.bround("score", 4), 9)), "type_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def assembled(candidates: DataFrame, credit: DataFrame) -> DataFrame:
    """What a viewer is told of each candidate: its label (with a colour, if there is one), how often and how long its
    set-ups are on screen, and from when to when. ``candidates``: from :func:`candidates`, with label, color and key.
    ``credit``: from :func:`credited`."""
    seen = credit.groupBy("scene", "type_id").agg(
        F.count(F.lit(1)).alias("seen_count"), F.min("start").alias("first_seen"), F.max("end").alias("last_seen"),
        F.bround(F.sum(F.col("end") - F.col("start")), 3).alias("screen_time"),
    )
    colored = F.concat_ws(" ", F.concat(F.upper(F.substr("color", F.lit(1), F.lit(1))), F.lower(F.substr("color", F.lit(2)))), F.lower("label"))
    label = F.when(F.col("displayed") & F.col("color").isNotNull(), colored).otherwise(F.col("label"))
    rows = candidates.join(seen, ["scene", "type_id"], "left").withColumn("label", label)
    return rows.select(
        "scene", "place", "key", "type_id", "label", F.bround("score", 4).alias("detection_confidence"), "relevance", "displayed", "hidden_reason",
        F.coalesce("seen_count", F.lit(0).cast("long")).alias("seen_count"), F.col("seen").alias("detected_in_unique_shots"), "first_seen", "last_seen", "screen_time", "max_instances",
    )


#: Raw detections that a candidate's debug block lists.
MOST_RAW = 12


def documents(candidates: DataFrame, credit: DataFrame, detections: DataFrame, scenes: DataFrame, contexts: DataFrame, floor: float) -> DataFrame:
    """One nested document for each scene: scene, unique_shots, unique_shots_analysed, context (venue, venue_category, venue_confidence, environment), categories_present
    (in order: of shown candidates and of the venue) and candidates, in order of place: what :func:`assembled` tells of each, and
    category, color, best (det, shot, box), occurrences in order of time, and debug (size, centrality and persistence as factors, the confidence that was needed, the
    shots it was detected in, its MOST_RAW best raw detections).

    ``candidates``: from :func:`candidates` with key, label, color, category. ``credit``: from :func:`credited`. ``detections``: scene, type_id, det, score,
    shot, box columns. ``scenes``: scene, unique_shots. ``contexts``: scene, venue, venue_category, venue_confidence, environment. Scenes without
    candidates have an empty list. Lists are as long as a scene has types, shots of a set-up and, in debug, at most MOST_RAW."""
    key = ["scene", "type_id"]
    told = assembled(candidates, credit)
    seen = credit.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "shot", "unit", "detected"))).alias("occurrences"))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "det"))
    raw = detections.select(*key, "det", "score", "shot", F.struct("x1", "y1", "x2", "y2").alias("box")).withColumn("turn", turn)
    first = F.when(F.col("turn") <= MOST_RAW, F.struct("turn", "det", F.bround("score", 4).alias("score"), "shot", "box"))
    raw = raw.groupBy(*key).agg(F.array_sort(F.collect_list(first)).alias("raw"), F.array_sort(F.collect_set("shot")).alias("shots"), F.max_by("shot", -F.col("turn")).alias("shot"))
    need = F.greatest(F.lit(floor), F.coalesce("tier", F.lit(0.0)))
    best = F.struct("det", F.struct("x1", "y1", "x2", "y2").alias("box")).alias("best")
    more = candidates.select(*key, "category", F.when(F.col("displayed"), F.col("color")).alias("color"), best, F.struct("size", "centrality", "persistence").alias("factors"), need.alias("need"))
    empty = lambda c, like: F.coalesce(c, F.filter(like, lambda x: F.lit(False)))
    rows = told.join(more, key).join(seen, key, "left").join(raw, key, "left")
    debug = F.struct("factors", F.col("need").alias("threshold"), F.col("shots").alias("unique_shot_ids"), F.transform("raw", lambda r: r.dropFields("turn")).alias("detections")).alias("debug")
    flat = [c for c in told.columns if c not in ("scene", "place")]
    rows = rows.withColumn("occurrences", empty(F.col("occurrences"), F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in seen.schema["occurrences"].dataType.elementType]))))
    one = F.struct("place", *flat, "category", "color", F.col("best").withField("shot", F.col("shot")).alias("best"), "occurrences", debug)
    listed = rows.groupBy("scene").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    analysed = detections.groupBy("scene").agg(F.countDistinct("shot").alias("unique_shots_analysed"))
    out = scenes.join(listed, "scene", "left").join(analysed, "scene", "left").join(contexts, "scene", "left")
    shown = F.transform(F.filter("candidates", lambda c: c["displayed"]), lambda c: c["category"])
    present = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(shown, F.array()), F.array("venue_category")))))
    context = F.struct("venue", "venue_category", "venue_confidence", "environment").alias("context")
    kind = listed.schema["candidates"].dataType.simpleString()
    return out.select("scene", "unique_shots", F.coalesce("unique_shots_analysed", F.lit(0).cast("long")).alias("unique_shots_analysed"), context, present.alias("categories_present"), F.coalesce("candidates", F.array().cast(kind)).alias("candidates"))


def run_summary(shots: DataFrame, frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """The twelve counters of a run, one row. ``shots``: scene, unit (the set-up). ``frames``: a row for each frame that was
    needed: scene, unit, state ('inferred', 'cached' or 'skipped'), seconds (of inference). ``candidates``: displayed."""
    units = shots.select("scene", "unit").distinct().agg(F.count(F.lit(1)).alias("unique_shots"))
    total = shots.agg(F.countDistinct("scene").alias("scenes"), F.count(F.lit(1)).alias("original_shots"))
    state = lambda *names: F.count_if(F.col("state").isin(*names))
    seconds = F.avg(F.when(F.col("state") == "inferred", F.col("seconds")))
    asked = frames.agg(
        F.count(F.lit(1)).alias("frames_needed"), state("inferred", "cached").alias("frames_analysed"), state("inferred").alias("frames_inferred_now"),
        state("cached").alias("frames_from_cache"), state("skipped").alias("frames_skipped"), F.bround(seconds, 4).alias("mean_seconds_per_frame"),
    )
    told = candidates.agg(F.count_if("displayed").alias("candidates_shown"), F.count_if(~F.col("displayed")).alias("candidates_hidden"))
    one = F.lit(1).alias("_one")
    rows = total.select("*", one)
    for part in (units, asked, told):  # a row each
        rows = rows.join(part.select("*", one), "_one")
    return rows.withColumn("inference_avoided_by_unique_shots", F.col("original_shots") - F.col("unique_shots")).drop("_one")


#: Rows of a taxonomy up to which its prompts are named.
MOST_PROMPTS = 100_000


def prompts_hash(taxonomy: DataFrame) -> DataFrame:
    """The name of what a detector is asked: one row, prompts_hash. Fixed format, by which stored detections are found:
    a JSON list of [prompt, type] in order. ``taxonomy``: place, type_id, prompts array<string>, a table of at most
    MOST_PROMPTS rows that a person wrote; prompts in ASCII."""
    if taxonomy.limit(MOST_PROMPTS + 1).count() > MOST_PROMPTS:
        raise ValueError(f"a taxonomy of more than {MOST_PROMPTS} types")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    rows = taxonomy.select("place", "type_id", F.posexplode("prompts").alias("at", "prompt"))
    pair = F.concat(F.lit("["), quoted(F.col("prompt")), F.lit(", "), quoted(F.col("type_id")), F.lit("]"))
    every = F.array_sort(F.collect_list(F.struct("place", "at", pair.alias("pair"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(every, lambda x: x["pair"]), ", "), F.lit("]"))
    return rows.agg(F.substring(F.sha1(listed), 1, 10).alias("prompts_hash"))


def candidate_key(type_id: Column, frame_hash: Column, box: list[Column]) -> Column:
    """A short stable name of a candidate, from what it is and where it was seen. Fixed format, by which stored verdicts
    join: type|hash|[x1, y1, x2, y2], sides to 3 places without trailing zeros but one."""
    sides = F.concat(F.lit("["), F.concat_ws(", ", *[F.bround(b, 3).cast("string") for b in box]), F.lit("]"))
    return F.substring(F.sha1(F.concat_ws("|", type_id, frame_hash, sides)), 1, 12)


def crop(rows: DataFrame, width: int, height: int, pad: float = 0.15, least: int = 64) -> DataFrame:
    """Pixel rectangles around boxes, padded, at least so large, inside the picture: left, top, right, bottom."""
    out = rows
    for side, lo, hi, extent in (("left", "x1", "x2", width), ("top", "y1", "y2", height)):
        far = {"left": "right", "top": "bottom"}[side]
        half = F.greatest((F.col(hi) - F.col(lo)) * extent * (0.5 + pad), F.lit(least / 2.0))
        middle = (F.col(lo) + F.col(hi)) / 2 * extent
        out = out.withColumn(side, F.floor(F.greatest(F.lit(0.0), middle - half))).withColumn(far, F.floor(F.least(F.lit(float(extent)), middle + half)))
    return out
