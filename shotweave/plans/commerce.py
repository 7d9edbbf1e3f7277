"""Queries over detections, scene context and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boxes, context, review
from ..sources.adapters import by_scene, document_reviews, embedding_shots, line_parts, order_detections, table
from .registry import query
from .segmentation import EMB

DET = """d AS (SELECT l_orderkey AS scene, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS det,
  p_type AS type_id, p_brand AS grp, l_discount * 10 AS score, (l_linenumber - 1) * 0.1::DOUBLE AS x1, l_tax * 5 AS y1,
  least(1.0, (l_linenumber - 1) * 0.1::DOUBLE + (0.1::DOUBLE + l_quantity / 100)) AS x2, least(1.0, l_tax * 5 + (0.1::DOUBLE + l_quantity / 100)) AS y2, l_suppkey % 5 AS shot, 0.5::DOUBLE + p_size / 100 AS base
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
IOU = """(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) /
  ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))))"""
CLASH = f"((a.type_id = b.type_id AND {IOU} > 0.5) OR (a.grp = b.grp AND {IOU} > 0.6) OR {IOU} > 0.85)"
AREA = "greatest(0, x2 - x1) * greatest(0, y2 - y1)"
SIZE = f"round(CASE WHEN {AREA} <= 0 THEN 0 ELSE least(1.0, sqrt({AREA} / 0.01)) * CASE WHEN {AREA} > 0.6 THEN greatest(0.3, 1 - ({AREA} - 0.6) / 0.4 * 0.7) ELSE 1 END END, 3)"
CENTRE = "round(greatest(0, 1 - sqrt(power((x1 + x2) / 2 - 0.5, 2) + power((y1 + y2) / 2 - 0.5, 2)) / 0.7071), 3)"
TYPES = DET + f""",
fr AS (SELECT *, count(*) OVER (PARTITION BY scene, type_id, shot) AS in_frame, row_number() OVER (PARTITION BY scene, type_id ORDER BY score DESC, {AREA} DESC, det) AS best
  FROM d),
tg AS (SELECT scene, type_id, count(*) AS detections, count(DISTINCT shot) AS seen, max(in_frame) AS max_instances, min(det) FILTER (best = 1) AS det, min(score) FILTER (best = 1) AS score, min(base) FILTER (best = 1) AS base,
  min(x1) FILTER (best = 1) AS x1, min(y1) FILTER (best = 1) AS y1, min(x2) FILTER (best = 1) AS x2, min(y2) FILTER (best = 1) AS y2 FROM fr GROUP BY scene, type_id),
rl AS (SELECT *, {SIZE} AS size, {CENTRE} AS centrality, round(least(1.0, seen / 3.0::DOUBLE), 3) AS persistence FROM tg),
rv AS (SELECT *, round(base * (0.6::DOUBLE + 0.2::DOUBLE * size + 0.08::DOUBLE * centrality + 0.12::DOUBLE * persistence) + 1e-9, 4) AS relevance FROM rl),
ti AS (SELECT p_type AS type_id, round(avg(p_size) / 100, 2) AS tier FROM part GROUP BY p_type),
cd AS (SELECT rv.*, CASE WHEN score < greatest(0.4, coalesce(tier, 0)) THEN 'low detector confidence' WHEN relevance < 0.45 THEN 'low commercial relevance' END AS hidden_reason
  FROM rv LEFT JOIN ti USING (type_id))"""


def _tiers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type_id")).agg(F.round(F.avg("p_size") / 100, 2).alias("tier"))


def _candidates(spark, sf_dir) -> DataFrame:
    return boxes.candidates(order_detections(spark, sf_dir), _tiers(spark, sf_dir), 0.4, 0.45)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {DET} SELECT scene, det, round({AREA}, 6) AS area, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM d WHERE x2 - x1 > 0.004 AND y2 - y1 > 0.004")
def box_geometry(spark, sf_dir):
    rows = boxes.clamped(order_detections(spark, sf_dir))
    return rows.select("scene", "det", F.round(boxes.area(), 6).alias("area"), F.round((F.col("x1") + F.col("x2")) / 2, 6).alias("cx"), F.round((F.col("y1") + F.col("y2")) / 2, 6).alias("cy"))


@query(f"WITH {DET} SELECT a.scene, a.det AS a, b.det AS b, round({IOU} + 1e-9, 6) AS iou, {CLASH} AS clash FROM d a JOIN d b ON a.scene = b.scene AND a.det < b.det")
def box_iou_pairs(spark, sf_dir):
    rows = order_detections(spark, sf_dir).select("scene", F.struct(*boxes.BOX).alias("box"))
    a, b = rows.select("scene", F.col("box").alias("a")), rows.select("scene", F.col("box").alias("b"))
    pairs = a.join(b, "scene").where("a.det < b.det")
    return pairs.select("scene", F.col("a.det").alias("a"), F.col("b.det").alias("b"), F.round(boxes.iou(F.col("a"), F.col("b")) + 1e-9, 6).alias("iou"), boxes.clash(F.col("a"), F.col("b")).alias("clash"))


@query(f"""WITH RECURSIVE {DET}, o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, det) AS k FROM d),
x AS (SELECT a.scene, a.k AS ka, b.k AS kb FROM o a JOIN o b ON a.scene = b.scene AND a.k < b.k AND {CLASH}),
xl AS (SELECT o.scene, o.k, o.det, coalesce((SELECT list(ka) FROM x WHERE x.scene = o.scene AND x.kb = o.k), []) AS before FROM o),
g AS (SELECT scene, 0 AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT scene FROM o)
  UNION ALL SELECT g.scene, xl.k, CASE WHEN list_has_any(g.kept, xl.before) THEN g.kept ELSE list_append(g.kept, xl.k) END FROM g
  JOIN xl ON xl.scene = g.scene AND xl.k = g.k + 1),
e AS (SELECT scene, unnest(arg_max(kept, k)) AS k FROM g GROUP BY scene) SELECT e.scene, o.det FROM e JOIN o ON o.scene = e.scene AND o.k = e.k""")
def frame_nms(spark, sf_dir):
    return boxes.suppressed(order_detections(spark, sf_dir), ["scene"]).select("scene", "det")


@query(f"WITH {TYPES} SELECT scene, type_id, detections, seen, max_instances FROM tg")
def type_groups(spark, sf_dir):
    return boxes.type_groups(order_detections(spark, sf_dir)).select("scene", "type_id", "detections", "seen", "max_instances")


@query(f"WITH {DET} SELECT scene, shot, max(n) AS max_instances FROM (SELECT scene, shot, type_id, count(*) AS n FROM d GROUP BY ALL) GROUP BY scene, shot")
def max_instances(spark, sf_dir):
    rows = order_detections(spark, sf_dir).groupBy("scene", "shot", "type_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("scene", "shot").agg(F.max("n").alias("max_instances"))


@query(f"WITH {TYPES} SELECT scene, type_id, det, round(score, 6) AS score FROM tg")
def best_detection(spark, sf_dir):
    return _round(boxes.type_groups(order_detections(spark, sf_dir)).select("scene", "type_id", "det", "score"), "score")


@query(f"WITH {TYPES} SELECT scene, type_id, size, centrality, persistence FROM rl")
def relevance_factors(spark, sf_dir):
    return boxes.with_relevance(boxes.type_groups(order_detections(spark, sf_dir)), "seen").select("scene", "type_id", "size", "centrality", "persistence")


@query(f"WITH {TYPES} SELECT scene, type_id, relevance FROM rv")
def candidate_relevance(spark, sf_dir):
    return boxes.with_relevance(boxes.type_groups(order_detections(spark, sf_dir)), "seen").select("scene", "type_id", "relevance")


@query(f"WITH {TYPES} SELECT scene, type_id, hidden_reason IS NULL AS displayed, hidden_reason FROM cd")
def display_rule(spark, sf_dir):
    return _candidates(spark, sf_dir).select("scene", "type_id", "displayed", "hidden_reason")


@query(f"WITH {TYPES} SELECT scene, type_id, relevance, detections, row_number() OVER (PARTITION BY scene ORDER BY hidden_reason IS NULL DESC, round(relevance * score, 9) DESC, type_id) AS place FROM cd")
def scene_catalogue(spark, sf_dir):
    return _candidates(spark, sf_dir).select("scene", "type_id", "relevance", "detections", "place")


@query(f"WITH {TYPES} SELECT type_id, count(*) AS n FROM cd WHERE hidden_reason IS NULL GROUP BY type_id")
def category_counts(spark, sf_dir):
    return _candidates(spark, sf_dir).where("displayed").groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TYPES}, c AS (SELECT DISTINCT scene, type_id FROM cd WHERE hidden_reason IS NULL UNION SELECT o_orderkey, o_orderpriority FROM orders
  WHERE o_orderstatus = 'P')
SELECT scene, array_to_string(list(type_id ORDER BY type_id), ',') AS categories FROM c GROUP BY scene""")
def categories_present(spark, sf_dir):
    """Distinct shown categories of a scene, with that of its venue."""
    shown = _candidates(spark, sf_dir).where("displayed").select("scene", "type_id")
    venue = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("scene"), F.col("o_orderpriority").alias("type_id"))
    return shown.unionByName(venue).groupBy("scene").agg(F.array_join(F.sort_array(F.collect_set("type_id")), ",").alias("categories"))


@query(f"WITH {TYPES} SELECT scene, type_id FROM cd WHERE type_id = 'ECONOMY' AND hidden_reason IS NULL UNION ALL SELECT scene, type_id FROM cd WHERE type_id = 'PROMO' AND hidden_reason IS NOT NULL")
def category_filter(spark, sf_dir):
    """What a viewer that filters by category sees, and a developer's view of the hidden rows of another."""
    rows = _candidates(spark, sf_dir)
    return rows.where((F.col("type_id") == "ECONOMY") & F.col("displayed")).unionByName(rows.where((F.col("type_id") == "PROMO") & ~F.col("displayed"))).select("scene", "type_id")


@query(f"WITH {DET} SELECT scene, type_id, det, rank FROM (SELECT *, row_number() OVER (PARTITION BY scene, type_id ORDER BY score DESC, det) AS rank FROM d) WHERE rank <= 12")
def top12_detections(spark, sf_dir):
    w = Window.partitionBy("scene", "type_id").orderBy(F.desc("score"), "det")
    return order_detections(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 12").select("scene", "type_id", "det", "rank")


OCC = """oc AS (SELECT l_orderkey AS scene, CAST(l_suppkey % 5 AS VARCHAR) AS unit, min(l_linenumber) AS first, CAST(l_linenumber AS BIGINT) AS shot
  FROM lineitem GROUP BY 1, 2, 4)"""


CREDIT = f"""{OCC}, dt AS (SELECT DISTINCT scene, CAST(shot AS VARCHAR) AS unit, type_id FROM d),
rp AS (SELECT scene, unit, min(shot) AS rep_shot FROM oc GROUP BY scene, unit),
c AS (SELECT dt.scene, type_id, oc.shot, min(dt.unit) AS unit, arg_min(CAST(oc.shot = rep_shot AS BOOLEAN), dt.unit) AS detected
  FROM dt JOIN oc ON oc.scene = dt.scene AND oc.unit = dt.unit JOIN rp ON rp.scene = dt.scene AND rp.unit = dt.unit GROUP BY dt.scene, type_id, oc.shot)"""


def _credit(spark, sf_dir, detections: DataFrame | None = None) -> DataFrame:
    """A unit is seen where its lines lie; what its first line shows counts for all of them."""
    detections = (detections or order_detections(spark, sf_dir)).withColumn("unit", F.col("shot").cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    occ = lines.select(F.col("l_orderkey").alias("scene"), F.pmod("l_suppkey", F.lit(5)).cast("string").alias("unit"), F.col("l_linenumber").cast("long").alias("shot"))
    occ = by_scene(occ, "scene", line_parts(lines)).distinct()
    occ = occ.withColumn("start", F.col("shot") * 4.0).withColumn("end", F.col("shot") * 4.0 + 4)
    rep = occ.groupBy("scene", "unit").agg(F.min("shot").alias("rep_shot"))
    return boxes.credited(detections.select("scene", "unit", "type_id").distinct().join(rep, ["scene", "unit"]), occ)


@query(f"WITH {DET}, {CREDIT} SELECT scene, type_id, shot, shot * 4.0::DOUBLE AS start, unit, detected FROM c")
def type_occurrences(spark, sf_dir):
    return _credit(spark, sf_dir).select("scene", "type_id", "shot", "start", "unit", "detected")


@query(f"""WITH {TYPES}, {CREDIT},
oc2 AS (SELECT scene, type_id, count(*) AS seen_count, min(shot) * 4.0::DOUBLE AS first_seen, max(shot) * 4.0::DOUBLE + 4 AS last_seen, count(*) * 4.0::DOUBLE AS screen_time
  FROM c GROUP BY scene, type_id),
pl AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY hidden_reason IS NULL DESC, round(relevance * score, 9) DESC, type_id) AS place FROM cd)
SELECT scene, place, type_id, seen AS detected_in_unique_shots, relevance, hidden_reason IS NULL AS displayed, hidden_reason, max_instances, round_even(score, 4) AS detection_confidence,
  CASE WHEN hidden_reason IS NULL AND score > 0.05 THEN (CASE WHEN score > 0.07 THEN 'Red ' ELSE 'Blue ' END) || lower(type_id) ELSE type_id END AS label,
  left(sha1(type_id || '|' || det || '|[' || CAST(round_even(x1, 3) AS DOUBLE) || ', ' || CAST(round_even(y1, 3) AS DOUBLE) || ', ' || CAST(round_even(x2, 3) AS DOUBLE) || ', ' || CAST(round_even(y2, 3) AS DOUBLE) || ']'), 12) AS key,
  coalesce(seen_count, 0) AS seen_count, first_seen, last_seen, screen_time FROM pl LEFT JOIN oc2 USING (scene, type_id)""")
def commercial_result(spark, sf_dir):
    """Every candidate of every scene as a viewer is told of it."""
    rows = _candidates(spark, sf_dir)
    key = boxes.candidate_key(F.col("type_id"), F.col("det").cast("string"), [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    color = F.when(F.col("score") > 0.07, "red").when(F.col("score") > 0.05, "blue")
    return boxes.assembled(rows.withColumns({"key": key, "color": color, "label": F.col("type_id")}), _credit(spark, sf_dir))


@query(f"""WITH {TYPES}, {CREDIT},
oc2 AS (SELECT scene, type_id, count(*) AS seen_count, string_agg(shot || ':' || unit || ':' || CASE WHEN detected THEN 'y' ELSE 'n' END, ',' ORDER BY shot) AS occ FROM c GROUP BY scene, type_id),
pl AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY hidden_reason IS NULL DESC, round(relevance * round_even(score, 4), 9) DESC, type_id) AS place FROM cd),
rw AS (SELECT scene, type_id, string_agg(det, ',' ORDER BY score DESC, det) FILTER (turn <= {boxes.MOST_RAW}) AS raw, string_agg(DISTINCT shot, ',' ORDER BY shot) AS shots, arg_min(shot, turn) AS best_shot
  FROM (SELECT *, row_number() OVER (PARTITION BY scene, type_id ORDER BY score DESC, det) AS turn FROM d) GROUP BY scene, type_id),
ln AS (SELECT scene, string_agg(concat_ws('|', place, type_id, CASE WHEN hidden_reason IS NULL THEN 'shown' ELSE hidden_reason END, CAST(round(relevance * 10000) AS BIGINT), coalesce(seen_count, 0), det, best_shot, coalesce(occ, ''), raw, shots), chr(10) ORDER BY place) AS lines,
  list_distinct(list(split_part(type_id, ' ', 1)) FILTER (hidden_reason IS NULL)) AS cats FROM pl LEFT JOIN oc2 USING (scene, type_id) JOIN rw USING (scene, type_id) GROUP BY scene),
ct AS (SELECT o_orderkey AS scene, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS venue FROM orders),
us AS (SELECT l_orderkey AS scene, count(DISTINCT l_suppkey % 5) AS n FROM lineitem GROUP BY 1)
SELECT us.scene, us.n AS unique_shots, (SELECT count(DISTINCT shot) FROM d WHERE d.scene = us.scene) AS unique_shots_analysed, venue,
  array_to_string(list_sort(list_distinct(coalesce(cats, []) || CASE WHEN venue IS NULL THEN [] ELSE ['VENUE'] END)), ',') AS categories, coalesce(lines, '') AS lines
FROM us LEFT JOIN ln ON ln.scene = us.scene LEFT JOIN ct ON ct.scene = us.scene""")
def commercial_documents(spark, sf_dir):
    """The nested document of each scene, its parts told in lines."""
    from ..sources.tables import materialised

    lines = table(spark, sf_dir, "lineitem")
    parts = line_parts(lines)
    detections = by_scene(materialised(order_detections(spark, sf_dir), "detections"), "scene", parts)
    rows = boxes.candidates(detections, _tiers(spark, sf_dir), 0.4, 0.45)
    key = boxes.candidate_key(F.col("type_id"), F.col("det").cast("string"), [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    rows = rows.withColumns({"key": key, "color": F.lit("red"), "label": F.col("type_id"), "category": F.split_part("type_id", F.lit(" "), F.lit(1))})
    units = lines.select(F.col("l_orderkey").alias("scene"), F.pmod("l_suppkey", F.lit(5)).alias("unit"))
    scenes = by_scene(units, "scene", parts).groupBy("scene").agg(F.countDistinct("unit").alias("unique_shots"))
    venue = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    contexts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene"), venue.alias("venue"), F.when(venue.isNotNull(), "VENUE").alias("venue_category"), F.lit(0.9).alias("venue_confidence"), F.lit("indoors").alias("environment"))
    docs = boxes.documents(rows, _credit(spark, sf_dir, detections), detections, scenes, by_scene(contexts, "scene", parts), 0.4)
    occ = lambda c: F.array_join(F.transform(c["occurrences"], lambda o: F.concat_ws(":", o["shot"], o["unit"], F.when(o["detected"], "y").otherwise("n"))), ",")
    line = lambda c: F.concat_ws(
        "|", c["place"], c["type_id"], F.when(c["displayed"], "shown").otherwise(c["hidden_reason"]), F.round(c["relevance"] * 10000).cast("long"), c["seen_count"], c["best"]["det"], c["best"]["shot"],
        occ(c), F.array_join(F.transform(c["debug"]["detections"], lambda d: d["det"].cast("string")), ","), F.array_join(c["debug"]["unique_shot_ids"].cast("array<string>"), ","),
    )
    lines = F.array_join(F.transform("candidates", line), "\n").alias("lines")
    return docs.select("scene", "unique_shots", "unique_shots_analysed", "context.venue", F.array_join("categories_present", ",").alias("categories"), lines)


@query("""WITH t AS (SELECT p_type AS type_id, min(p_partkey) AS place, list_sort(list(DISTINCT p_brand)) AS prompts FROM part GROUP BY p_type),
p AS (SELECT place, type_id, unnest(prompts) AS prompt, unnest(range(0, len(prompts))) AS at_ FROM t)
SELECT left(sha1('[' || string_agg('["' || prompt || '", "' || type_id || '"]', ', ' ORDER BY place, at_) || ']'), 10) AS prompts_hash FROM p""")
def taxonomy_prompts_hash(spark, sf_dir):
    """Types of parts as a taxonomy, their brands as prompts."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type_id"))
    return boxes.prompts_hash(rows.agg(F.min("p_partkey").alias("place"), F.sort_array(F.collect_set("p_brand")).alias("prompts")))


@query(f"""WITH {TYPES},
f AS (SELECT l_orderkey AS scene, l_suppkey % 5 AS unit, CASE l_returnflag WHEN 'R' THEN 'skipped' WHEN 'A' THEN 'cached' ELSE 'inferred' END AS state, l_tax AS seconds
  FROM lineitem)
SELECT (SELECT count(DISTINCT scene) FROM f) AS scenes, (SELECT count(*) FROM f) AS original_shots,
  (SELECT count(*) FROM (SELECT DISTINCT scene, unit FROM f)) AS unique_shots, (SELECT count(*) FROM f) AS frames_needed,
  (SELECT count(*) FROM f WHERE state <> 'skipped') AS frames_analysed, (SELECT count(*) FROM f WHERE state = 'inferred') AS frames_inferred_now,
  (SELECT count(*) FROM f WHERE state = 'cached') AS frames_from_cache, (SELECT count(*) FROM f WHERE state = 'skipped') AS frames_skipped,
  (SELECT count(*) FROM cd WHERE hidden_reason IS NULL) AS candidates_shown, (SELECT count(*) FROM cd WHERE hidden_reason IS NOT NULL) AS candidates_hidden,
  (SELECT count(*) FROM f) - (SELECT count(*) FROM (SELECT DISTINCT scene, unit FROM f)) AS inference_avoided_by_unique_shots,
  (SELECT round_even(avg(seconds), 4) FROM f WHERE state = 'inferred') AS mean_seconds_per_frame""")
def run_counters(spark, sf_dir):
    """The counters of one run over lines as frames: one frame for each shot."""
    state = F.when(F.col("l_returnflag") == "R", "skipped").when(F.col("l_returnflag") == "A", "cached").otherwise("inferred")
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.pmod("l_suppkey", F.lit(5)).alias("unit"), state.alias("state"), F.col("l_tax").alias("seconds"))
    return boxes.run_summary(frames, frames, _candidates(spark, sf_dir))


@query(f"WITH {DET} SELECT DISTINCT scene, shot FROM d")
def distinct_representatives(spark, sf_dir):
    return order_detections(spark, sf_dir).select("scene", "shot").distinct()


@query("""SELECT o_orderkey AS scene, CASE WHEN count(l_orderkey) = 0 THEN 'not_run' WHEN count(*) FILTER (l_returnflag = 'R') = count(*) THEN 'unavailable' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'partial' ELSE 'ready' END AS status
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def run_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderkey").alias("scene"))
    rows = rows.agg(F.count("l_orderkey").alias("frames"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    status = F.when(F.col("frames") == 0, "not_run").when(F.col("failed") == F.col("frames"), "unavailable").when(F.col("failed") > 0, "partial").otherwise("ready")
    return rows.select("scene", status.alias("status"))


# --- context ---------------------------------------------------------------------------------------
#: The first prompts of the taxonomy are taken from the data: one vector for each of six contexts, two for the first.
PROMPTS = """pm AS (SELECT 'c' || CAST(vec_id % 6 AS VARCHAR) AS context, vec_id AS prompt, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 7),
pn AS (SELECT context, prompt, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS vec FROM pm)"""
VOTES = EMB + f""", {PROMPTS},
lg AS (SELECT video, shot, context, 10.0 * max(list_inner_product(clip, vec)) AS z FROM s, pn GROUP BY ALL),
ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY video, shot)) AS e
  FROM lg), pb AS (SELECT video, shot, context, e / sum(e) OVER (PARTITION BY video, shot) AS p FROM ex),
ms AS (SELECT video, shot // 5 AS scene, context, sum(4.0 * p) AS mass, sum(4.0) AS seconds FROM pb WHERE context <> 'c5' GROUP BY ALL),
vt AS (SELECT video, scene, context, mass / sum(mass) OVER (PARTITION BY video, scene) AS vote, sum(mass) OVER (PARTITION BY video, scene) / seconds AS evidence
  FROM ms)"""


def _prompts(spark, sf_dir) -> DataFrame:
    rows = embedding_shots(spark, sf_dir).where("video = 0 AND shot < 7")
    return rows.select(F.concat(F.lit("c"), F.pmod("shot", F.lit(6)).cast("string")).alias("context"), F.col("shot").alias("prompt"), F.col("clip").alias("vec"))


def _votes(spark, sf_dir) -> DataFrame:
    shots = embedding_shots(spark, sf_dir).withColumn("scene", F.floor(F.col("shot") / 5))
    prompts = _prompts(spark, sf_dir)
    p = context.facet_probabilities(shots.select("video", "shot", "clip"), prompts, 10.0)
    return context.venue_votes(p, shots, prompts.select("context").distinct().where("context <> 'c5'"))


@query(f"WITH {VOTES} SELECT video, scene, context, round(vote, 6) AS vote, round(evidence, 6) AS evidence FROM vt")
def venue_votes(spark, sf_dir):
    return _round(_votes(spark, sf_dir), "vote", "evidence")


@query(f"WITH {VOTES} SELECT video, scene, context, round(vote, 6) AS vote, place FROM (SELECT *, row_number() OVER (PARTITION BY video, scene ORDER BY vote DESC, context) AS place FROM vt) WHERE place <= 3")
def venue_top3(spark, sf_dir):
    return _round(context.ranked(_votes(spark, sf_dir)), "vote").select("video", "scene", "context", "vote", "place")


@query(f"""WITH {VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY video, scene ORDER BY vote DESC, context) AS place FROM vt)
SELECT a.video, a.scene, CASE WHEN a.evidence >= 0.1 AND a.vote >= 0.28 AND a.vote - b.vote >= 0.02 THEN a.context END AS venue, round(a.vote, 6) AS confidence, round(a.evidence, 6) AS evidence
  FROM r a JOIN r b ON b.video = a.video AND b.scene = a.scene AND a.place = 1 AND b.place = 2""")
def venue_gating(spark, sf_dir):
    return _round(context.gated(_votes(spark, sf_dir), 0.28, 0.02, 0.1), "confidence", "evidence")


@query(f"""WITH {VOTES}, en AS (SELECT video, shot // 5 AS scene, context, sum(4.0 * p) / sum(4.0) AS p FROM pb GROUP BY ALL)
SELECT video, scene, CASE WHEN max(p) >= 0.25 THEN arg_max(context, p) END AS environment, round(max(p), 6) AS confidence FROM en GROUP BY video, scene""")
def environment_gating(spark, sf_dir):
    shots = embedding_shots(spark, sf_dir).withColumn("scene", F.floor(F.col("shot") / 5))
    p = context.facet_probabilities(shots.select("video", "shot", "clip"), _prompts(spark, sf_dir), 10.0)
    return _round(context.environments(p, shots, 0.25), "confidence")


# --- reviews ---------------------------------------------------------------------------------------
REV = """r AS (SELECT doc_id AS key, CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS verdict, toxic = 1 AS flagged, lang AS category, source AS type_id, least(1.0, n_chars / 4000.0::DOUBLE) AS confidence, (doc_id % 10) / 10.0::DOUBLE AS relevance
  FROM labels JOIN documents USING (doc_id))"""
COUNTS = "count(*) AS reviewed, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, round(count(*) FILTER (verdict = 'correct') / nullif(count(*), 0), 4) AS precision"


def _reviews(spark, sf_dir) -> DataFrame:
    return document_reviews(spark, sf_dir).withColumn("verdict", F.when(F.col("correct"), "correct").otherwise("wrong")).drop("correct")


@query(f"WITH {REV} SELECT {COUNTS} FROM r")
def review_overall(spark, sf_dir):
    return review.precision(_reviews(spark, sf_dir), [])


@query(f"WITH {REV} SELECT category, type_id, flagged, {COUNTS} FROM r GROUP BY GROUPING SETS ((), (category), (type_id), (flagged))")
def review_precision_sets(spark, sf_dir):
    return review.precision_sets(_reviews(spark, sf_dir), ["category", "type_id", "flagged"])


@query(f"WITH {REV}, t AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7]::DOUBLE[]) AS threshold) SELECT threshold, count(key) AS reviewed, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, round(count(*) FILTER (verdict = 'correct') / nullif(count(key), 0), 4) AS precision FROM t LEFT JOIN r ON confidence >= threshold AND relevance >= 0.45 GROUP BY threshold")
def review_threshold_sweep(spark, sf_dir):
    return review.threshold_sweep(_reviews(spark, sf_dir), 0.45)


@query(f"""WITH {REV}, t AS (SELECT source AS type_id, round(avg(n_chars) / 10000, 2) AS tier FROM documents WHERE source <> 'src3' GROUP BY source)
SELECT type_id, {COUNTS} FROM r LEFT JOIN t USING (type_id) WHERE confidence >= greatest(0.2, coalesce(tier, 1.0)) AND relevance >= 0.3 GROUP BY type_id""")
def review_join(spark, sf_dir):
    """Precision of what the rule shows, by type; a type that the taxonomy doesn't know needs full confidence."""
    tiers = table(spark, sf_dir, "documents").where("source <> 'src3'").groupBy(F.col("source").alias("type_id")).agg(F.round(F.avg("n_chars") / 10000, 2).alias("tier"))
    rows = _reviews(spark, sf_dir).join(tiers, "type_id", "left")
    return review.precision(rows.where(review.shown(F.col("confidence"), F.col("relevance"), review.tier_need(F.col("tier"), 0.2), 0.3)), ["type_id"])


@query("""WITH v AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN '' WHEN value > 40 THEN 'correct' ELSE 'wrong' END AS verdict
  FROM events)
SELECT key, verdict FROM (SELECT key, arg_max(verdict, seq) AS verdict FROM v GROUP BY key) WHERE verdict <> ''""")
def latest_verdict(spark, sf_dir):
    verdict = F.when(F.col("event_type") == "error", "").when(F.col("value") > 40, "correct").otherwise("wrong")
    return review.latest(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), verdict.alias("verdict")), ["key"])


@query(f"WITH {REV} SELECT type_id, reviewed, row_number() OVER (ORDER BY reviewed DESC, type_id) AS place FROM (SELECT type_id, count(*) AS reviewed FROM r GROUP BY type_id)")
def review_order(spark, sf_dir):
    rows = review.precision(_reviews(spark, sf_dir), ["type_id"]).select("type_id", "reviewed")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("reviewed"), "type_id")).cast("long"))


HSV = """hv AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 7.1 AS h, (l_partkey % 100) / 100.0::DOUBLE AS s, (l_suppkey % 20) / 20.0::DOUBLE AS v
  FROM lineitem),
cn AS (SELECT *, CASE WHEN h < 15 THEN 'red' WHEN h < 40 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 260 THEN 'blue' WHEN h < 300 THEN 'purple' WHEN h < 340 THEN 'pink' WHEN h < 361 THEN 'red' END AS hue
  FROM hv),
nm AS (SELECT *, CASE WHEN v < 0.18 THEN 'black' WHEN s < 0.16 AND v > 0.78 THEN 'white' WHEN s < 0.16 THEN 'grey' WHEN hue IN ('orange', 'yellow') AND s < 0.35 AND v >= 0.55 THEN 'beige' WHEN hue IN ('orange', 'yellow') AND v < 0.55 AND h < 50 THEN 'brown' ELSE hue END AS color
  FROM cn)"""


def _colours(spark, sf_dir) -> DataFrame:
    """A pixel for each line: its box is the order."""
    from ..functions import colour

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") * 7.1).alias("h"), (F.pmod("l_partkey", F.lit(100)) / 100.0).alias("s"), (F.pmod("l_suppkey", F.lit(20)) / 20.0).alias("v"))
    return rows.withColumn("color", colour.name(F.col("h"), F.col("s"), F.col("v")))


@query(f"WITH {HSV} SELECT color, count(*) AS n FROM nm GROUP BY color")
def color_names(spark, sf_dir):
    return _colours(spark, sf_dir).groupBy("color").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HSV}, k0 AS (SELECT l_orderkey, color, count(*) AS c FROM nm
  GROUP BY l_orderkey, color), k AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey) AS n FROM k0),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, color) AS place FROM k)
  SELECT l_orderkey, CASE WHEN c / n >= 0.55 THEN color END AS color, round(c / n, 6) AS share FROM r WHERE place = 1""")
def dominant_color(spark, sf_dir):
    from ..functions import colour

    return colour.dominant(_colours(spark, sf_dir), ["l_orderkey"]).withColumn("share", F.round("share", 6))
