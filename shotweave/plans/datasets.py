"""Queries over labelled datasets, roles, manifests, corrections, figures and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import diagnose, labels
from ..sources.adapters import document_reviews, embedding_shots, event_frames, table
from .commerce import REV
from .registry import query
from .timelines import FRAMES


# --- roles -----------------------------------------------------------------------------------------
@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def roles_semi(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unassigned_anti(spark, sf_dir):
    assigned = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(assigned, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey AS stem, count(DISTINCT o_orderpriority) AS n_roles FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def role_overlap(spark, sf_dir):
    return labels.overlapping_roles(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), F.col("o_orderpriority").alias("role")))


@query("SELECT DISTINCT o_custkey AS stem FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def role_union(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), "o_orderpriority")
    return rows.where("o_orderpriority = '1-URGENT'").select("stem").union(rows.where("o_orderpriority = '2-HIGH'").select("stem")).distinct()


@query("SELECT o_custkey AS stem FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def role_intersection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), "o_orderpriority")
    return rows.where("o_orderpriority = '1-URGENT'").select("stem").intersect(rows.where("o_orderpriority = '2-HIGH'").select("stem"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def recent_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(12).select("o_orderkey", "o_orderdate")


@query("""WITH m AS (SELECT c_custkey AS key, c_acctbal AS bytes
  FROM customer), f AS (SELECT o_custkey AS key, max(o_totalprice) AS bytes, min(o_orderstatus) AS state FROM orders GROUP BY o_custkey)
SELECT m.key, CASE WHEN f.key IS NULL THEN 'missing' WHEN state = 'P' THEN 'placeholder' WHEN f.bytes > 400000 THEN 'different size' WHEN m.bytes < 0 THEN 'sha mismatch' ELSE 'ok' END AS status
  FROM m LEFT JOIN f ON m.key = f.key""")
def manifest_check(spark, sf_dir):
    """A manifest against what is there."""
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("want"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("bytes"), F.min("o_orderstatus").alias("state"))
    status = F.when(F.col("bytes").isNull(), "missing").when(F.col("state") == "P", "placeholder").when(F.col("bytes") > 400000, "different size").when(F.col("want") < 0, "sha mismatch").otherwise("ok")
    return manifest.join(found, "key", "left").select("key", status.alias("status"))


# --- caches and fingerprints -----------------------------------------------------------------------
@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_miss(spark, sf_dir):
    """What an incremental run still has to do."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id, coalesce('q' || l.quality, left(sha1(d.text), 16)) AS frame_hash FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0")
def frame_hash_memo(spark, sf_dir):
    """A remembered hash where there is one, else one from the content."""
    memo = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("known"))
    rows = table(spark, sf_dir, "documents").join(memo, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("known", F.substring(F.sha1("text"), 1, 16)).alias("frame_hash"))


@query("SELECT doc_id, left(sha1(CAST(strlen(text) AS VARCHAR) || left(text, 400) || right(text, 400)), 16) AS content_id FROM documents")
def content_id(spark, sf_dir):
    """An id from a content's size, its beginning and its end."""
    parts = F.concat(F.octet_length("text").cast("string"), F.left("text", F.lit(400)), F.right("text", F.lit(400)))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha1(parts), 1, 16).alias("content_id"))


@query("""WITH h AS (SELECT source, sha256(text) AS s FROM documents),
t AS (SELECT source, count(*) AS rows, sum(CAST('0x' || s[1:15] AS HUGEINT)) AS a, sum(CAST('0x' || s[16:30] AS HUGEINT)) AS b FROM h GROUP BY source)
SELECT source, rows, sha256(concat_ws('/', rows, a, b)) AS fingerprint FROM t""")
def dataset_fingerprint(spark, sf_dir):
    """One hash for each part of a dataset, whatever the order of its rows: of sums of their hashes, which add up within
    tasks first, so a part may be of any size."""
    part = lambda at: F.sum(F.conv(F.substring("s", at, 15), 16, 10).cast("decimal(38,0)"))
    rows = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("s"))
    rows = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), part(1).alias("a"), part(16).alias("b"))
    return rows.select("source", "rows", F.sha2(F.concat_ws("/", *[F.col(c).cast("string") for c in ("rows", "a", "b")]), 256).alias("fingerprint"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, lower(regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS lang, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([^/]*)$', 1) AS stem FROM pages""")
def text_probe(spark, sf_dir):
    """Fields from text by regular expressions, as a prober's output is read."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), F.lower(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1)).alias("lang"),
        F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"/([^/]*)$", 1).alias("stem"),
    )


@query("SELECT doc_id, lang IN ('en', 'de') AND n_chars < 5000 AS playable FROM documents")
def playable(spark, sf_dir):
    """Which items need no proxy."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("lang").isin("en", "de") & (F.col("n_chars") < 5000)).alias("playable"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))")
def taxonomy_semi(spark, sf_dir):
    """Detections of types that the taxonomy has."""
    known = table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "PROMO"))
    return table(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH w AS (SELECT p_type, unnest(string_split(p_name, ' ')) AS prompt FROM part)
SELECT prompt, count(*) AS parts, count(DISTINCT p_type) AS types FROM w GROUP BY prompt""")
def prompt_explode(spark, sf_dir):
    """All prompts of the taxonomy, and how many types claim each."""
    rows = table(spark, sf_dir, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("prompt"))
    return rows.groupBy("prompt").agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("p_type").alias("types"))


# --- corrections -----------------------------------------------------------------------------------
LOG = """g AS (SELECT conv_id AS video, turn AS seq, CASE WHEN turn % 5 = 4 THEN 'confirm' WHEN length(text) % 23 = 0 THEN 'clear' WHEN length(text) % 29 = 0 THEN 'reset' WHEN turn % 3 = 0 THEN 'merge' ELSE 'split' END AS op, length(text) % 4 AS scene_index, (length(text) % 900 + 50) / 10.0::DOUBLE AS moment
  FROM conversations)"""


def correction_log(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as operations on the boundaries of a video."""
    n = F.length("text")
    op = F.when(F.col("turn") % 5 == 4, "confirm").when(n % 23 == 0, "clear").when(n % 29 == 0, "reset").when(F.col("turn") % 3 == 0, "merge").otherwise("split")
    return conversations.select(F.col("conv_id").alias("video"), F.col("turn").alias("seq"), op.alias("op"), (n % 4).cast("int").alias("scene_index"), ((n % 900 + 50) / 10.0).alias("at"), F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("predicted"), F.lit(100.0).alias("duration"))


def _log(spark, sf_dir) -> DataFrame:
    return correction_log(table(spark, sf_dir, "conversations"))


correction_replay_sql = f"""WITH RECURSIVE {LOG},
cu AS (SELECT vec_id // 50 AS video, vec_id % 50 * 4.0::DOUBLE AS cut FROM embeddings WHERE vec_id % 50 > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY seq, op, scene_index, moment) AS k FROM g),
sn AS (SELECT q.video, k, op, scene_index, round(coalesce(min(cut), moment), 3) AS moment FROM q
  LEFT JOIN cu ON cu.video = q.video AND cut BETWEEN moment - 2.0 AND moment + 0.5 GROUP BY q.video, k, op, scene_index, moment),
r AS (SELECT DISTINCT video, 0 AS k, [10.0::DOUBLE, 20.0, 30.0] AS b, []::DOUBLE[] AS neg, []::DOUBLE[] AS pos, 0 AS refused FROM g
  UNION ALL SELECT r.video, s.k,
    CASE WHEN op = 'clear' THEN [] WHEN op = 'reset' THEN [10.0, 20.0, 30.0] WHEN op = 'merge' AND scene_index < len(b) THEN b[:scene_index] || b[scene_index + 2:]
      WHEN op = 'split' AND fits THEN list_sort(list_append(b, moment)) ELSE b END,
    CASE WHEN op = 'reset' THEN [] WHEN op = 'merge' AND scene_index < len(b) THEN list_append(neg, b[scene_index + 1]) ELSE neg END,
    CASE WHEN op = 'reset' THEN [] WHEN op = 'split' AND fits THEN list_append(pos, moment) ELSE pos END,
    refused + CASE WHEN (op = 'merge' AND scene_index >= len(b)) OR (op = 'split' AND NOT fits) THEN 1 ELSE 0 END
 
  FROM (SELECT r.*, s.k AS next, op, scene_index, moment, moment > 0 AND moment < 100 AND coalesce(list_min(list_transform(b, lambda x: abs(x - moment))), 1) >= 0.25 AS fits
    FROM r JOIN sn s ON s.video = r.video AND s.k = r.k + 1) r JOIN (SELECT DISTINCT k FROM sn) s ON s.k = r.next),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY k DESC) AS last FROM r) WHERE last = 1),
o AS (SELECT video, 'boundary' AS kind, unnest(b) AS time, unnest(range(0, len(b))) AS place FROM e
  UNION ALL SELECT video, 'hard_negative', unnest(neg), unnest(range(0, len(neg))) FROM e
  UNION ALL SELECT video, 'hard_positive', unnest(pos), unnest(range(0, len(pos))) FROM e
  UNION ALL SELECT video, 'refused', CAST(refused AS DOUBLE), 0 FROM e)
SELECT video, kind, CAST(place AS BIGINT) AS place, time FROM o"""


@query(correction_replay_sql)
def correction_replay(spark, sf_dir):
    """What a log of corrections leaves, the examples that it makes, and how many operations were refused, a row each."""
    cuts = embedding_shots(spark, sf_dir).where("shot > 0").select("video", F.col("start").alias("time"))
    return replay_rows(labels.replayed(_log(spark, sf_dir), cuts))


def replay_rows(end: DataFrame) -> DataFrame:
    """Boundaries, examples and refusals of each video, a row each."""
    kinds = {"boundary": F.col("boundaries"), "hard_negative": F.col("hard_negatives"), "hard_positive": F.col("hard_positives"), "refused": F.array(F.col("refused").cast("double"))}
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("times")) for k, v in kinds.items()])).alias("k")
    rows = end.select("video", kind).select("video", "k.kind", F.posexplode("k.times").alias("place", "time"))
    return rows.select("video", "kind", F.col("place").cast("long").alias("place"), "time")


@query(f"WITH {LOG} SELECT video, count(*) FILTER (op = 'merge') AS merges, count(*) FILTER (op = 'split') AS splits, count(*) FILTER (op = 'confirm') AS confirms FROM g GROUP BY video")
def correction_counts(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("video").agg(*[F.count_if(F.col("op") == op).alias(f"{op}s") for op in ("merge", "split", "confirm")])


@query(f"WITH {LOG} SELECT video, CASE WHEN count(*) FILTER (op IN ('merge', 'split')) = 0 THEN 'confirmed' WHEN bool_or(op = 'confirm') THEN 'edited' ELSE 'draft' END AS method FROM g GROUP BY video")
def provenance(spark, sf_dir):
    edits = F.count_if(F.col("op").isin("merge", "split"))
    method = F.when(edits == 0, "confirmed").when(F.bool_or(F.col("op") == "confirm"), "edited").otherwise("draft")
    return _log(spark, sf_dir).groupBy("video").agg(method.alias("method"))


@query(f"""WITH {FRAMES}, b AS (SELECT video, list(CAST(frame AS DOUBLE) ORDER BY frame) AS b, count(*) AS duration FROM f WHERE prob > 100 GROUP BY video)
SELECT video, array_to_string(list_concat(b[:1], b[3:]), ',') AS merged, array_to_string(CASE WHEN list_min(list_transform(b, lambda x: abs(x - 10.5))) >= 0.25 AND 10.5 < 60 THEN list_sort(list_append(b, 10.5)) ELSE b END, ',') AS split
  FROM b""")
def boundary_edit(spark, sf_dir):
    """One boundary taken out and one put in."""
    rows = event_frames(spark, sf_dir).where("prob > 100").groupBy("video").agg(F.sort_array(F.collect_list(F.col("frame").cast("double"))).alias("b"))
    return rows.select("video", F.array_join(labels.merged(F.col("b"), F.lit(1)).cast("array<string>"), ",").alias("merged"), F.array_join(labels.inserted(F.col("b"), F.lit(10.5), F.lit(60.0)).cast("array<string>"), ",").alias("split"))


# --- figures ---------------------------------------------------------------------------------------
@query(f"""WITH {REV}, k AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY confidence) + (count(*) OVER (PARTITION BY category, confidence) - 1) / 2 AS rk FROM r)
SELECT category, count(*) AS n, round((sum(rk) FILTER (verdict = 'correct') - count(*) FILTER (verdict = 'correct') * (count(*) FILTER (verdict = 'correct') + 1) / 2) / nullif(count(*) FILTER (verdict = 'correct') * count(*) FILTER (verdict = 'wrong'), 0), 6) AS auc
  FROM k GROUP BY category""")
def rank_auc(spark, sf_dir):
    out = diagnose.rank_auc(document_reviews(spark, sf_dir), "confidence", "correct", ["category"])
    return out.withColumn("auc", F.round("auc", 6))


@query(f"""WITH {REV}, v AS (SELECT category, confidence, count(*) AS c, count(*) FILTER (verdict = 'correct') AS p FROM r GROUP BY ALL),
t AS (SELECT category, (confidence + lead(confidence) OVER w) / 2 AS threshold, sum(p) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tp, sum(c) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS said, sum(p) OVER (PARTITION BY category) AS ap
  FROM v WINDOW w AS (PARTITION BY category ORDER BY confidence)),
x AS (SELECT *, 2 * tp / (said + ap) AS f1 FROM t WHERE threshold IS NOT NULL)
SELECT category, round(threshold, 6) AS threshold, round(f1, 6) AS f1
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, threshold) AS k FROM x) WHERE k = 1""")
def best_threshold_f1(spark, sf_dir):
    out = diagnose.best_threshold(document_reviews(spark, sf_dir), "confidence", "correct", ["category"])
    return out.withColumns({"threshold": F.round("threshold", 6), "f1": F.round("f1", 6)})


@query(f"WITH {REV} SELECT least(9, CAST(floor(confidence * 10) AS BIGINT)) AS bin, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong FROM r GROUP BY 1")
def binned_distribution(spark, sf_dir):
    bin_ = F.least(F.lit(9), F.floor(F.col("confidence") * 10))
    return document_reviews(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("wrong"))


@query(f"""WITH {REV}, q AS (SELECT type_id, round(confidence, 2) AS x, verdict = 'correct' AS ok FROM r),
v AS (SELECT type_id, x, count(*) AS c, count(*) FILTER (ok) AS p FROM q GROUP BY ALL),
k AS (SELECT DISTINCT x FROM v), ids AS (SELECT DISTINCT type_id FROM v),
h AS (SELECT ids.type_id, k.x, coalesce(sum(v.c), 0) AS c, coalesce(sum(v.p), 0) AS p FROM ids CROSS JOIN k LEFT
  JOIN v ON v.x = k.x AND v.type_id <> ids.type_id GROUP BY ALL),
s AS (SELECT type_id, x, sum(c) OVER w AS said, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY type_id) AS ap, c
  FROM h WINDOW w AS (PARTITION BY type_id ORDER BY x DESC)),
f AS (SELECT type_id, x, round(2 * tp / nullif(said + ap, 0), 12) AS f1 FROM s WHERE c > 0),
b AS (SELECT type_id, x AS cut FROM (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY f1 DESC, x) AS n FROM f) WHERE n = 1)
SELECT round(2 * count(*) FILTER (q.x >= cut AND ok) / (2 * count(*) FILTER (q.x >= cut AND ok) + count(*) FILTER (q.x >= cut AND NOT ok) + count(*) FILTER (q.x < cut AND ok)), 6) AS f1
  FROM q JOIN b USING (type_id)""")
def pooled_lovo_f1(spark, sf_dir):
    """Each group judged by the threshold, to two places, whose F1 is best over all the others; counts pooled."""
    rows = document_reviews(spark, sf_dir).select("type_id", F.round("confidence", 2).alias("x"), "correct")
    return rows.join(diagnose.left_out_threshold(rows, "x", "correct", "type_id"), "type_id").agg(F.round(diagnose.pooled_f1(F.col("x") >= F.col("cut"), F.col("correct")), 6).alias("f1"))


FIGURES = """fg AS (SELECT category AS method, type_id AS video, avg(CASE WHEN verdict = 'correct' THEN 1.0::DOUBLE ELSE 0 END) AS f1 FROM r GROUP BY ALL)"""


@query(f"""WITH {REV}, {FIGURES},
g AS (SELECT a.method, ascii(right(a.video, 1)) % 3 = 0 AS val, a.f1, b.f1 AS base FROM fg a JOIN fg b ON a.video = b.video AND b.method = 'en'),
m AS (SELECT method, avg(f1) FILTER (NOT val) AS dev_f1, avg(base) FILTER (NOT val) AS dev_base, avg(f1) FILTER (val) AS val_f1, avg(base) FILTER (val) AS val_base,
  count(*) FILTER (f1 > base + 1e-9) AS wins, count(*) FILTER (f1 < base - 1e-9) AS losses FROM g GROUP BY method)
SELECT method, round(dev_f1, 6) AS dev_f1, round(val_f1, 6) AS val_f1, wins, losses,
  CASE WHEN method <> 'en' THEN dev_f1 > dev_base AND coalesce(val_f1 >= val_base, true) AND wins > losses END AS accepted FROM m""")
def wins_losses(spark, sf_dir):
    """Methods against a baseline over the same videos, and which may replace it. Some videos are for validation."""
    from ..operators.learn import accepted

    rows = document_reviews(spark, sf_dir).groupBy(F.col("category").alias("method"), F.col("type_id").alias("video")).agg(F.avg(F.col("correct").cast("double")).alias("f1"))
    part = F.when(F.ascii(F.right("video", F.lit(1))) % 3 == 0, "val").otherwise("dev")
    return accepted(rows.withColumn("part", part), "en").withColumns({"dev_f1": F.round("dev_f1", 6), "val_f1": F.round("val_f1", 6)})


@query("""WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS turn FROM documents)
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM t) WHERE place <= 24""")
def stratified_round_robin(spark, sf_dir):
    return diagnose.round_robin(table(spark, sf_dir, "documents"), "lang", "source", ["n_chars", "doc_id"], 24).select("doc_id", "lang", "source")
