"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, stored, text_or_empty

#: Most passes over a source's documents that flattening may ask for.
MAX_REPETITION = 2.0
#: Documents of a block; a source has at most MOST_BLOCKS blocks, and then larger ones.
PER_BLOCK, MOST_BLOCKS = 4096, 1_000_000
#: Sources up to which their weights are broadcast; beyond, they are joined by source.
MOST_BROADCAST = 10_000
GRID, ROUNDS = 32, 5
SEED = 11


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, name (doc_id as text, null: a hash of the text), source (null: ''), n_tokens: words and one end mark, so
    that an empty text counts too."""
    words = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty()))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = columns(docs, "doc_id", "text", "source")
    return rows.select("doc_id", name.alias("name"), source.alias("source"), (words + 1).cast("long").alias("n_tokens"))


def _curves(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float, float]]:
    """For each exponent a: a, the entropy of weights p**a, their sum, and the largest and smallest p**(a-1)."""
    a, p = F.col("a"), F.col("share")
    rows = shares.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a")).groupBy("a")
    rows = rows.agg(F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * F.log(p)).alias("s"), F.max(F.pow(p, a - 1)).alias("top"), F.min(F.pow(p, a - 1)).alias("low"))
    return sorted((r.a, math.log(r.z) - r.a * r.s / r.z, r.z, r.top, r.low) for r in rows.collect())


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repetition: float = MAX_REPETITION, budget_ratio: float | None = None) -> tuple[float, float, float]:
    """Bisect the exponent in [0, 1], GRID ways at a time, over a table of ``share`` (of all tokens, by source).

    With a target entropy: the largest exponent whose weights have at least that entropy (0 if none has). Else: the
    smallest exponent at which no source is repeated more than ``max_repetition`` times (1 if none keeps to it).
    Returns the exponent, the sum of p**exponent and the budget as a multiple of all tokens: ``budget_ratio``, or
    the smallest in which every source is passed at least once.
    """

    def good(row: tuple) -> bool:
        _, entropy, z, top, low = row
        if target_entropy is not None:
            return entropy >= target_entropy - 1e-12
        ratio = budget_ratio if budget_ratio is not None else z / low
        return ratio * top / z <= max_repetition * (1 + 1e-12)

    lo, hi, best = 0.0, 1.0, None
    for _ in range(ROUNDS):
        rows = _curves(shares, [lo + (hi - lo) * i / GRID for i in range(GRID + 1)])
        fits = [i for i, row in enumerate(rows) if good(row)]
        if target_entropy is not None:
            i = max(fits, default=0)
            lo, hi = rows[i][0], rows[min(i + 1, GRID)][0]
        else:
            i = min(fits, default=GRID)
            lo, hi = rows[max(i - 1, 0)][0], rows[i][0]
        best = rows[i]
        if lo == hi:
            break
    a, _, z, _, low = best
    return a, z, budget_ratio if budget_ratio is not None else z / low


def _key(*parts: Column | int) -> Column:
    """A number from a hash of the parts, below 2**60."""
    joined = F.concat_ws("|", *[F.coalesce((F.lit(p) if isinstance(p, int) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, target_entropy: float | None = None, max_repetition: float = MAX_REPETITION, budget_ratio: float | None = None, per_block: int = PER_BLOCK, seed: int = SEED) -> DataFrame:
    """Realise a temperature-flattened mixture of the sources of ``docs`` as an order of training.

    Each source's weight is its share of tokens to the power found by :func:`exponent`, normalised; its quota is the
    weight times the budget. Its documents lie in blocks by a hash of their id; each pass permutes the blocks by a
    hash of pass and block. Whole passes are taken while the quota lasts; of the last, whole blocks in order, and of
    one block the documents in order until the quota is met (the document that crosses it included).

    Returns a row for each time a document is used: doc_id, source, pass, n_tokens, weight, block_key, doc_key.
    Sorting by pass, block_key, doc_key gives the order, all sources interleaved block by block.
    With the default budget every row of ``docs`` is used at least once. A null source counts as ''. Rows of a null
    doc_id are dealt by their texts. Rows that repeat are rows of their own, told apart only where the quota cuts a block,
    in no stated order. Empty texts count one token. No rows give no rows. Extra columns, of whatever name, are not read.
    """
    rows = stored(measured(docs), "mixing-documents")
    sizes = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mixing-sources")
    total, n_sources = sizes.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total:
        total = 1
        a, z, ratio = 1.0, 1.0, 1.0
    else:
        a, z, ratio = exponent(sizes.select((F.col("tokens") / total).alias("share")), target_entropy, max_repetition, budget_ratio)
    weight = F.pow(F.col("tokens") / total, F.lit(a)) / z
    # Rounded to a token's fraction, so that a quota of whole passes isn't missed by the last digit.
    quota = F.round(F.col("weight") * ratio * total, 3)
    plans = sizes.withColumn("weight", weight).withColumn("quota", quota)
    plans = plans.withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
    plans = plans.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    plans = plans.withColumn("blocks", F.least(F.ceil(F.col("n") / per_block), F.lit(MOST_BLOCKS)).cast("long"))
    plans = plans.select("source", "weight", "passes", "rest", "blocks")
    plans = F.broadcast(plans) if n_sources <= MOST_BROADCAST else plans
    rows = rows.join(plans, "source").withColumn("block", F.pmod(_key(seed, F.col("name")), F.col("blocks")))

    blocks = rows.groupBy("source", "block", "passes", "rest").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy(_key(seed, F.col("passes"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("before < rest")
    blocks = stored(blocks.select("source", "block", (F.col("rest") - F.col("before")).alias("left"), (F.col("before") + F.col("tokens") > F.col("rest")).alias("cut")), "mixing-blocks")
    rows = rows.join(blocks, ["source", "block"], "left")
    whole = rows.where("cut IS NULL OR NOT cut").withColumn("copies", F.col("passes") + F.col("cut").isNotNull().cast("int"))
    within = Window.partitionBy("source", "block").orderBy(_key(seed, F.col("passes"), F.col("name")), "name").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.where("cut").withColumn("above", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    parts = parts.withColumn("copies", F.col("passes") + (F.col("above") < F.col("left")).cast("int")).drop("above")
    used = whole.unionByName(parts).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return used.select("doc_id", "source", "pass", "n_tokens", F.round("weight", 9).alias("weight"), _key(seed, F.col("pass"), F.col("source"), F.col("block")).alias("block_key"), _key(seed, F.col("pass"), F.col("name")).alias("doc_key"))


SQL = rf"""
WITH r AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name,
  coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n FROM r GROUP BY source),
t AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, max(tokens) / min(tokens) AS spread FROM s),
-- The smallest exponent, in steps of 2**-25, at which no source is repeated more than {MAX_REPETITION} times.
a AS (SELECT total, CASE WHEN spread <= {MAX_REPETITION} THEN 0.0::DOUBLE ELSE
  ceil((1 - ln({MAX_REPETITION}::DOUBLE) / ln(spread)) * 33554432) / 33554432 END AS a FROM t),
z AS (SELECT total, a, sum(power(tokens / total, a)) AS z, min(power(tokens / total, a - 1)) AS low FROM s, a GROUP BY total, a),
w AS (SELECT s.*, power(tokens / total, a) / z AS weight,
  round(power(tokens / total, a) / z * (z / low) * total, 3) AS quota, least(CAST(ceil(n / {PER_BLOCK}) AS BIGINT), {MOST_BLOCKS}) AS blocks FROM s, z),
p AS (SELECT *, CAST(floor(quota / tokens) AS BIGINT) AS passes, quota - floor(quota / tokens) * tokens AS rest FROM w),
d AS (SELECT r.*, weight, passes, rest, ('0x' || left(md5('{SEED}|' || name), 15))::BIGINT % blocks AS block FROM r JOIN p USING (source)),
b AS (SELECT source, block, passes, rest, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
c AS (SELECT *, 
  coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY ('0x' || left(md5('{SEED}|' || passes || '|' || source || '|' || block), 15))::BIGINT, block
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
e AS (SELECT d.*, c.before, c.tokens, 
  coalesce(sum(n_tokens) OVER (PARTITION BY d.source, d.block ORDER BY ('0x' || left(md5('{SEED}|' || d.passes || '|' || name), 15))::BIGINT, name
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM d JOIN c ON c.source = d.source AND c.block = d.block),
f AS (SELECT *, passes + CASE WHEN before >= rest THEN 0 WHEN before + tokens <= rest THEN 1 WHEN above < rest - before THEN 1 ELSE 0 END AS copies FROM e),
u AS (SELECT *, unnest(range(0, copies)) AS pass FROM f)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, n_tokens, round(weight, 9) AS weight,
       ('0x' || left(md5('{SEED}|' || pass || '|' || source || '|' || block), 15))::BIGINT AS block_key,
       ('0x' || left(md5('{SEED}|' || pass || '|' || name), 15))::BIGINT AS doc_key FROM u
"""
