"""Exact deduplication in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, columns, fresh, stored, text_or_empty

#: Rows of a group that meet in one join key; larger groups are dealt over several.
PER_SALT = 1000
#: Large groups that may be told to all tasks: tens of bytes each.
MOST_BROADCAST = 100_000


def exact_groups(docs: DataFrame, per_salt: int = PER_SALT) -> DataFrame:
    """Group equal texts: by a 128-bit hash of the text with each run of white space as one space,
    then by comparing the bytes of every member with those of the row that stays.

    Returns one row per row of ``docs``: doc_id, keep_id (smallest doc_id of the equal texts),
    group_size, kept, text_sha256. A null text counts as empty; empty texts are equal to each other.
    A null doc_id counts as larger than any other; a group of only null ids keeps them, with a null
    keep_id. Rows that repeat a doc_id with an equal text share one result, count in group_size and
    are all marked kept if theirs is the smallest id. An empty table gives an empty one. Other columns of ``docs``, of whatever
    name, are not looked at.

    Hashes are pre-aggregated before they are shuffled. Texts are dealt by id, so a hot group spreads
    over all tasks; its members then meet copies of their representative under salted keys. A member
    whose bytes differ (a hash collision) is grouped with its equals by its text.
    """
    norm = F.regexp_replace(text_or_empty(), SPACE, " ")
    docs = columns(docs, "doc_id", "text").withColumn("norm", norm)
    digest = docs.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    digest = stored(digest, "exact-digests")
    # Written, so that both sides of the join are plain exchanges, whose hot partitions Spark splits.
    groups = stored(digest.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "exact-groups")
    rows = _with_groups(digest, groups, per_salt)

    members = rows.where("n > 1").select("doc_id", "h", "keep_id", "n").distinct()
    texts = docs.select("doc_id", F.unhex(F.md5("norm")).alias("h"), "norm")
    same_row = texts["doc_id"].eqNullSafe(members["doc_id"]) & (texts["h"] == members["h"])
    texts = texts.join(members, same_row).select(members["doc_id"], members["h"], "keep_id", "n", "norm")
    texts = stored(texts.withColumn("salts", F.ceil(F.col("n") / per_salt).cast("int")), "exact-members")
    kept = (
        texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("h", "salts")
        .agg(F.min("norm").alias("kept_norm"))
        .select("h", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    odd = stored(salted.join(kept, ["h", "salt"]).where("norm <> kept_norm").select("doc_id", "h", "norm"), "exact-collisions")
    if odd.isEmpty():
        return _result(rows, F.col("keep_id"), F.col("n"))
    odd_groups = odd.groupBy("h", "norm").agg(F.min("doc_id").alias("odd_keep"), F.count(F.lit(1)).alias("odd_n"))
    odd_rows = odd.join(odd_groups, ["h", "norm"]).select(F.col("doc_id").alias("odd_id"), F.col("h").alias("odd_h"), "odd_keep", "odd_n").distinct()
    lost = odd_groups.groupBy(F.col("h").alias("lost_h")).agg(F.sum("odd_n").alias("lost_n"))

    rows = rows.join(odd_rows, rows["doc_id"].eqNullSafe(odd_rows["odd_id"]) & (rows["h"] == odd_rows["odd_h"]), "left")
    rows = rows.join(lost, rows["h"] == lost["lost_h"], "left")
    is_odd = F.col("odd_n").isNotNull()
    keep_id = F.when(is_odd, F.col("odd_keep")).otherwise(F.col("keep_id"))
    size = F.when(is_odd, F.col("odd_n")).otherwise(F.col("n") - F.coalesce("lost_n", F.lit(0)))
    return _result(rows, keep_id, size)


def _result(rows: DataFrame, keep_id: Column, size: Column) -> DataFrame:
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        size.cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _with_groups(digest: DataFrame, groups: DataFrame, per_salt: int) -> DataFrame:
    """Each row's group. Rows of groups over ``per_salt`` are dealt by group and salt, and so are copies of their group;
    the large groups are told to all tasks where they are few, else Spark's own splitting of hot partitions has to do."""
    large = groups.where(F.col("n") > per_salt)
    if large.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return digest.join(groups, "h")
    salts = F.ceil(F.col("n") / per_salt).cast("int")
    rows = digest.join(F.broadcast(large.select("h", salts.alias("salts"))), "h", "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "sha"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.join(copies, ["h", "salt"]).drop("salt")


def drop_copies(docs: DataFrame) -> DataFrame:
    """Stage form: one row of ``docs`` for each group of equal texts, that of the smallest doc_id, with all columns.
    Different texts under one doc_id, or under null, are groups of their own: each keeps a row."""
    sha, kept_id, kept_sha = fresh(docs, "sha", "kept_id", "kept_sha")
    groups = exact_groups(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    rows = docs.withColumn(sha, F.sha2(F.regexp_replace(text_or_empty(), SPACE, " "), 256))
    same_row = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha))
    return rows.join(groups, same_row, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
