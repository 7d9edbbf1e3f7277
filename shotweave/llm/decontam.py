"""Benchmark decontamination by template windows, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, stored, text_or_empty

# Units that are replaced after a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "inches", "feet", "miles", "pounds", "ounces", "dollars", "euros", "cents", "percent", "degrees", "metres", "meters", "litres", "liters", "grams", "kilograms", "kilometres", "kilometers"]
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
#: One or more capitalised words that don't begin a sentence.
NAME = r"([\p{Ll}\p{N},;] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"
UNIT = "\x01 *(" + "|".join(UNITS) + r")\b"
#: Placeholders of numbers, names and units.
SLOTS = {"number": "\x01", "name": "\x02", "unit": "\x03"}
#: The same for Spark's regular expressions: a repeated group that gives nothing back is matched in a loop. One that may give back is matched
#: by recursion, so that a run of some 2,000 names would overflow the stack and end the executor.
LOOPED_NUMBER, LOOPED_NAME = f"{NUMBER}+", f"{NAME.removesuffix(')')}+)"
BREAK = r"[^\p{L}\p{N}\x01-\x03]+"

WINDOW = 5
#: Share of an item's windows that a document must have.
COVERAGE = 0.5
#: Words in a row that are a benchmark passage in themselves.
LITERAL = 13
#: Characters from which one word alone is a passage (a clause of a script without spaces).
LONG_WORD = 8
#: Comes before all stretches of a pair but the best.
FIRST = -(1 << 62)
#: Rows of benchmark windows up to which they are broadcast; beyond, both sides are shuffled by hash.
MOST_BROADCAST = 1_000_000


def _numbered(text: Column) -> Column:
    return F.regexp_replace(text, LOOPED_NUMBER, " \x01 ")


def template(text: Column) -> Column:
    """The text's words in lower case, with typed placeholders for numbers, names and units after numbers."""
    text = F.regexp_replace(_numbered(text), UNIT, "\x01 \x03 ")
    text = F.regexp_replace(text, LOOPED_NAME, "$1\x02 ")
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def literal_tokens(text: Column) -> Column:
    """The text's words in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def slot_values(text: Column) -> dict[str, Column]:
    """The values that the k-th placeholder of each kind stands for, in order."""
    return {
        "number": F.regexp_extract_all(text, F.lit(f"({LOOPED_NUMBER})"), 1),
        "name": F.regexp_extract_all(F.regexp_replace(_numbered(text), UNIT, "\x01 \x03 "), F.lit(LOOPED_NAME), 2),
        "unit": F.regexp_extract_all(_numbered(text), F.lit(UNIT), 1),
    }


def _arrays_of_hashes(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` with n, their number of ``tokens``, and a column w<size> for each size: an array of which :func:`_whole`
    are the hashes of all windows of so many tokens, in order of place.

    Hashes of 1, 2, 4, ... tokens are built from each other, array by array, without joining words."""
    keep = [c for c in rows.columns if c != "tokens"]
    rows = rows.select(*keep, F.size("tokens").alias("n"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("h1"))
    powers = [1 << b for b in range(max(sizes).bit_length())]

    def after(name: str, by: int) -> Column:
        return F.slice(F.col(name), by + 1, F.greatest(F.size(name) - by, F.lit(0)))

    def joined(name: str, other: str, by: int) -> Column:
        return F.zip_with(F.col(name), after(other, by), lambda a, b: F.xxhash64(a, b))

    for size in powers[:-1]:
        rows = rows.withColumn(f"h{2 * size}", joined(f"h{size}", f"h{size}", size))
    for size in sizes:
        at = 1 << size.bit_length() - 1
        name = f"h{at}"
        for part in reversed([x for x in powers if x < at and x & size]):
            rows = rows.withColumn(f"p{size}", joined(name, f"h{part}", at))
            name, at = f"p{size}", at + part
        rows = rows.withColumn(f"w{size}", F.col(name))
    return rows.select(*keep, "n", *[f"w{size}" for size in sizes])


def _whole(size: int) -> Column:
    """The hashes of windows that don't run over the end. Exploded as an expression: of a column, Spark would ask for its
    size first, and for that build all arrays twice."""
    return F.slice(F.col(f"w{size}"), 1, F.greatest(F.col("n") - size + 1, F.lit(0)))


def windows(rows: DataFrame, window: int) -> DataFrame:
    """All windows of so many of the tokens of ``rows`` (tokens, and any others but n), one row each: the others, pos, h."""
    keep = [c for c in rows.columns if c != "tokens"]
    return _arrays_of_hashes(rows, [window]).select(*keep, F.posexplode(_whole(window)).alias("pos", "h"))


def _told_apart(size: int) -> Column:
    return F.transform(_whole(size), lambda h: F.xxhash64(h, F.lit(size)))


def literal_windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """The distinct windows of each of the ``sizes`` of the tokens of ``rows``, one row each: the other columns, h.
    Equal words of different sizes have different hashes."""
    keep = [c for c in rows.columns if c != "tokens"]
    told = F.concat(*[_told_apart(size) for size in sizes])
    return _arrays_of_hashes(rows, sizes).select(*keep, F.explode(F.array_distinct(told)).alias("h"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of each item with at least half of their tokens literal: item_id, bpos (first place), h, once (whether it is the
    only place; all count as such in an item that repeats every window), n_windows."""
    items = columns(benchmark, "item_id", "text").where("item_id IS NOT NULL").select(F.col("item_id").alias("id"), template(text_or_empty()).alias("tokens"))
    items = items.withColumn("literal", F.transform("tokens", lambda x: (~x.rlike("^[\x01-\x03]$")).cast("int")))
    literal = items.select("id", F.posexplode("literal").alias("at", "is_literal"))
    literal = literal.select("id", "is_literal", F.explode(F.sequence(F.greatest(F.col("at") - window + 1, F.lit(0)), "at")).alias("pos"))
    literal = literal.groupBy("id", "pos").agg(F.sum("is_literal").alias("n_literal"))
    told = windows(items, window).join(literal, ["id", "pos"]).where(F.col("n_literal") * 2 >= window)
    told = told.groupBy("id", "h").agg(F.min("pos").alias("bpos"), (F.count(F.lit(1)) == 1).alias("once"))
    n = told.groupBy("id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("once").alias("any_once"))
    return told.join(n, "id").select(F.col("id").alias("item_id"), "bpos", "h", (F.col("once") | ~F.col("any_once")).alias("once"), "n_windows")


def _count(tokens: str, upto: Column, mark: str) -> Column:
    return F.size(F.filter(F.slice(tokens, 1, upto), lambda x: x == mark))


def _chains(hits: DataFrame, window: int, coverage: float) -> DataFrame:
    """Stretches of a text in which an item's windows follow each other in the item's order, whatever was put in between or left out:
    row, item_id, turn, shift, begin, end; a row for each part of a stretch that lines up at one shift. ``hits``: row, item_id, n_windows, bpos, shift, once.

    A new stretch begins where a window that the item has once comes again or comes too early, or after more than an item's windows without any. Stretches with
    fewer than ``coverage`` of the item's windows are left out."""
    in_order = Window.partitionBy("row", "item_id").orderBy("pos", "bpos")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.withColumn("pos", F.col("bpos") + F.col("shift"))
    back = F.col("once") & (F.col("bpos") <= F.last(F.when(F.col("once"), F.col("bpos")), ignorenulls=True).over(before))
    far = F.col("pos") - F.lag("pos").over(in_order) > F.col("n_windows") + window
    rows = rows.withColumn("breaks", F.coalesce(back | far, F.lit(False)).cast("int"))
    rows = rows.withColumn("chain", F.sum("breaks").over(in_order))
    size = rows.groupBy("row", "item_id", "chain", "n_windows").agg(F.countDistinct("bpos").alias("n"), F.min("pos").alias("first"))
    size = size.where(F.col("n") >= coverage * F.col("n_windows")).select("row", "item_id", "chain", "n", "first")
    parts = rows.where("once").groupBy("row", "item_id", "chain", "shift").agg(F.min("bpos").alias("begin"), F.max("bpos").alias("end"))
    # Those with most windows come first, then the earliest; they come after the stretch of first occurrences, by any number above it.
    turn = (-F.col("n").cast("long") * (1 << 32) + F.col("first")).alias("turn")
    return parts.join(size, ["row", "item_id", "chain"]).select("row", "item_id", turn, "shift", "begin", "end")


def _pairs_of_slots(pairs: DataFrame, window: int) -> DataFrame:
    """Check the slots of aligned stretches. ``pairs``: row, item_id, turn, item_text, text, shift, begin, end (item windows); a stretch (turn)
    may have several."""
    value = {}
    for side, text in (("b", "item_text"), ("d", "text")):
        pairs = pairs.withColumn(f"{side}_tokens", template(F.col(text)))
        for kind, found in slot_values(F.col(text)).items():
            value[side, kind] = f"{side}_{kind}"
            pairs = pairs.withColumn(value[side, kind], found)
    pairs = pairs.drop("item_text", "text")
    at = F.explode(F.sequence(F.col("begin"), F.col("end") + window - 1)).alias("at")
    slots = []
    for kind, mark in SLOTS.items():
        one = pairs.where(F.array_contains("b_tokens", mark)).select("row", "item_id", "turn", "shift", "b_tokens", "d_tokens", value["b", kind], value["d", kind], at)
        one = one.where((F.try_element_at(F.col("b_tokens"), F.col("at") + 1) == mark) & (F.col("at") + F.col("shift") >= 0))
        one = one.where(F.try_element_at(F.col("d_tokens"), F.col("at") + F.col("shift") + 1) == mark)
        b = F.try_element_at(F.col(value["b", kind]), _count("b_tokens", F.col("at") + 1, mark))
        d = F.try_element_at(F.col(value["d", kind]), _count("d_tokens", F.col("at") + F.col("shift") + 1, mark))
        slots.append(one.select("row", "item_id", "turn", "at", (F.col("at") + F.col("shift")).alias("place"), F.lit(kind).alias("kind"), F.lower(b).alias("b"), F.lower(d).alias("d")).distinct())
    changed = F.sum((F.col("b") != F.col("d")).cast("int")).alias("changed")
    slots = reduce(DataFrame.unionByName, slots).groupBy("row", "item_id", "turn", "kind", "b")
    slots = slots.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("d").alias("n_d"), changed)
    totals = F.sum("n").alias("n_slots"), F.sum("changed").alias("n_changed"), (F.max("n_d") <= 1).alias("consistent")
    return slots.groupBy("row", "item_id", "turn").agg(*totals)


def _literal_hits(texts: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """Items that a text holds word for word, or ``size`` words of in a row: row, doc_id, item_id, n_literal (such windows)."""
    items = columns(benchmark, "item_id", "text").where("item_id IS NOT NULL").select("item_id", literal_tokens(text_or_empty()).alias("tokens"))
    # A short word alone is no passage.
    items = items.where((F.size("tokens") > 1) | ((F.size("tokens") == 1) & (F.length(F.col("tokens")[0]) >= LONG_WORD)))
    items = stored(items.withColumn("size", F.least(F.size("tokens"), F.lit(size))), "benchmark-tokens")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``size`` numbers
    if not sizes:
        return texts.select("row", "doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_literal")).limit(0)
    of_items = reduce(DataFrame.unionByName, [literal_windows(items.where(F.col("size") == k).drop("size"), [k]) for k in sizes])
    of_items = stored(of_items.distinct(), "benchmark-literals")
    side = F.broadcast(of_items) if of_items.count() <= MOST_BROADCAST else of_items
    hits = literal_windows(texts.select("row", "doc_id", literal_tokens(F.col("text")).alias("tokens")), sizes).join(side, "h")
    return hits.groupBy("row", "doc_id", "item_id").agg(F.countDistinct("h").alias("n_literal"))


def _found(texts: DataFrame, benchmark: DataFrame, window: int, coverage: float, literal: int) -> DataFrame:
    """Pairs of a text of ``texts`` (row: a name of id and text; doc_id, text) and an item: row, doc_id, item_id, and what
    ``contaminated`` returns of it, with the ``turn`` of the stretch that it tells of."""
    bench = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    side = F.broadcast(bench) if bench.count() <= MOST_BROADCAST else bench
    hits = windows(texts.select("row", "doc_id", template(F.col("text")).alias("tokens")), window).join(side, "h")
    hits = stored(hits.select("row", "doc_id", "item_id", "n_windows", "bpos", "once", (F.col("pos") - F.col("bpos")).alias("shift")).distinct(), "template-hits")
    pair = ["row", "doc_id", "item_id"]
    lined = hits.groupBy(*pair, "n_windows", "bpos").agg(F.min("shift").alias("shift"))
    matched = lined.groupBy(*pair, "n_windows").agg(F.count(F.lit(1)).alias("n_matched")).where(F.col("n_matched") >= coverage * F.col("n_windows"))
    run = [F.count(F.lit(1)).alias("n"), F.min("bpos").alias("begin"), F.max("bpos").alias("end")]
    runs = lined.groupBy("row", "item_id", "shift").agg(*run)
    best = runs.groupBy("row", "item_id").agg(F.max_by(F.struct("shift", "begin", "end"), F.struct("n", -F.col("shift"))).alias("run"))
    best = best.select("row", "item_id", F.lit(FIRST).alias("turn"), "run.*")
    likely = matched.select("row", "item_id")
    chains = _chains(hits.join(likely, ["row", "item_id"], "left_semi"), window, coverage)
    stretches = best.join(likely, ["row", "item_id"], "left_semi").unionByName(chains)
    stretches = stored(stretches.join(matched, ["row", "item_id"]), "template-matches")

    items = columns(benchmark, "item_id", "text").select("item_id", text_or_empty().alias("item_text"))
    items = items.groupBy("item_id").agg(F.max("item_text").alias("item_text"))
    hit_texts = texts.select("row", "text").join(stretches.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    slots = _pairs_of_slots(stretches.drop("doc_id", "n_windows", "n_matched").join(items, "item_id").join(hit_texts, "row"), window)
    told = stretches.select(*pair, "n_windows", "n_matched", "turn").distinct().join(slots, ["row", "item_id", "turn"], "left").where(F.coalesce("consistent", F.lit(True)))
    told = told.groupBy(*pair, "n_windows", "n_matched").agg(F.min_by(F.struct("turn", "n_slots", "n_changed"), "turn").alias("told"))
    told = told.select(*pair, "n_windows", "n_matched", "told.*")
    literals = _literal_hits(texts, benchmark, literal)
    both = told.withColumn("n_literal", F.lit(0).cast("long")).unionByName(literals, allowMissingColumns=True)
    numbers = ["n_windows", "n_matched", "turn", "n_slots", "n_changed", "n_literal"]
    return both.groupBy(*pair).agg(*[F.max(c).alias(c) for c in numbers])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, by which rows of equal id and text are one; none for texts without anything to find."""
    text = text_or_empty()
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text)))
    return columns(docs, "doc_id", "text").select(name.alias("row"), "doc_id", text.alias("text")).where("text <> ''")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, literal: int = LITERAL) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, word for word or with other numbers, names or units.

    A pair counts in either of two ways.
    1. By template: the document has at least ``coverage`` of the item's distinct template windows and, in a stretch of
       it, each value of the item stands for one value in the document. Stretches are the one where most windows' first
       occurrences line up, and any that has ``coverage`` of the windows in the item's order (:func:`_chains`), with words put in
       between or left out; the result tells of the first of these that is consistent, then of the one with most windows, then of the earliest.
    2. Literally: the document has ``literal`` words of the item in a row or, of a shorter item, all words, whatever
       case, white space and punctuation. This finds items that are short or mostly numbers, names and units, and
       passages of an item. An item of one word of fewer than LONG_WORD characters is not looked for.
    Returns doc_id, item_id, n_windows, n_matched, n_slots, n_changed (slots with another value than the item's), all 0
    if the pair is only literal, and n_literal (distinct literal windows of the item that the document has).

    Null texts count as empty and match nothing; items of a null id aren't looked for. Texts of one doc_id (null is one
    too) are judged apart; of several that hold an item, the row tells of the one with most template windows. Equal items
    each give a pair. An empty table of either gives an empty one. Extra columns, of whatever name, are not read. Texts are searched whole.
    """
    found = _found(_texts(docs), benchmark, window, coverage, literal)
    order = F.struct(-F.col("n_matched"), "turn", "n_slots", "n_changed")
    told = found.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("n_windows", "n_matched", "n_slots", "n_changed"), F.when(F.col("turn").isNotNull(), order)).alias("told"), F.max("n_literal").alias("n_literal"))
    numbers = [F.coalesce(f"told.{c}", F.lit(0)).cast("long").alias(c) for c in ("n_windows", "n_matched", "n_slots", "n_changed")]
    return told.select("doc_id", "item_id", *numbers, "n_literal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Stage form: the rows of ``docs`` that hold no benchmark item, all columns. Rows of one doc_id, or of null, are
    judged by their own texts."""
    (bad_row,) = fresh(docs, "bad_row")
    bad = _found(_texts(docs), benchmark, WINDOW, COVERAGE, LITERAL).select(F.col("row").alias(bad_row)).distinct()
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text_or_empty())))
    return docs.join(bad, name == F.col(bad_row), "left_anti")


_T = rf"""regexp_replace(regexp_replace(regexp_replace(%s, '{NUMBER}', ' ' || chr(1) || ' ', 'g'), '{UNIT.replace(chr(1), chr(92) + 'x01')}', chr(1) || ' ' || chr(3) || ' ', 'g'), '{NAME}', '\1' || chr(2) || ' ', 'g')"""
_TOKENS = rf"list_filter(regexp_split_to_array(lower({_T}), '{BREAK}'), lambda x: x <> '')"
_N = f"regexp_replace(%s, '{NUMBER}', ' ' || chr(1) || ' ', 'g')"
_VALUES = {
    "number": f"regexp_extract_all(%s, '({NUMBER})', 1)",
    "name": f"regexp_extract_all(regexp_replace({_N}, '{UNIT.replace(chr(1), chr(92) + 'x01')}', chr(1) || ' ' || chr(3) || ' ', 'g'), '{NAME}', 2)",
    "unit": f"regexp_extract_all({_N}, '{UNIT.replace(chr(1), chr(92) + 'x01')}', 1)",
}


def _slots_sql(kind: str) -> str:
    mark = f"chr({ord(SLOTS[kind])})"
    count = lambda tokens, upto: f"len(list_filter({tokens}[1:{upto}], lambda x: x = {mark}))"
    value = lambda text, tokens, upto: f"lower(({_VALUES[kind] % text})[{count(tokens, upto)}])"
    return f"""SELECT DISTINCT r, item_id, turn, k, k + shift AS place, '{kind}' AS kind,
    {value('item_text', 'bt', 'k + 1')} AS b,
    {value('text', 'dt', 'k + shift + 1')} AS d
  FROM ex WHERE bt[k + 1] = {mark} AND k + shift >= 0 AND dt[k + shift + 1] = {mark}"""


_WORDS = r"list_filter(regexp_split_to_array(lower(%s), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_MARKS = "(chr(1), chr(2), chr(3))"
_PAIR = "r, doc_id, item_id"

SQL = rf"""
WITH dk AS (
  SELECT DISTINCT md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || text) AS r, doc_id, text, {_TOKENS % "text"} AS tk
  FROM documents WHERE text <> ''),
bk AS (SELECT item_id, max(text) AS item_text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id),
bi AS (SELECT *, {_TOKENS % "item_text"} AS tk FROM bk),
bp AS (
  SELECT item_id, tk, unnest(range(0, len(tk) - {WINDOW - 1})) AS pos
  FROM (SELECT item_id, {_TOKENS % "text"} AS tk FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
bv AS (
  SELECT item_id, array_to_string(tk[pos + 1:pos + {WINDOW}], ' ') AS w, min(pos) AS bpos, count(*) = 1 AS alone FROM bp
  WHERE 2 * len(list_filter(tk[pos + 1:pos + {WINDOW}], lambda x: x NOT IN {_MARKS})) >= {WINDOW} GROUP BY 1, 2),
bn AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_windows, alone OR NOT max(alone) OVER (PARTITION BY item_id) AS once FROM bv),
dp AS (SELECT r, doc_id, tk, unnest(range(0, len(tk) - {WINDOW - 1})) AS pos FROM dk),
dw AS (SELECT r, doc_id, pos, array_to_string(tk[pos + 1:pos + {WINDOW}], ' ') AS w FROM dp),
ht AS (SELECT DISTINCT {_PAIR}, n_windows, bpos, once, pos, pos - bpos AS shift FROM dw JOIN bn USING (w)),
ln AS (SELECT {_PAIR}, n_windows, bpos, min(shift) AS shift FROM ht GROUP BY ALL),
mt AS (SELECT {_PAIR}, n_windows, count(*) AS n_matched FROM ln GROUP BY ALL HAVING count(*) >= {COVERAGE} * n_windows),
rn AS (SELECT r, item_id, shift, count(*) AS n, min(bpos) AS lo, max(bpos) AS hi FROM ln GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY n DESC, shift) AS k FROM rn),
-- The places of a pair in order, and the places where a stretch begins: by looking back from each one.
hm AS (SELECT ht.* FROM ht JOIN mt ON mt.r = ht.r AND mt.item_id = ht.item_id),
hl AS (SELECT r, item_id, list({{'pos': pos, 'bpos': bpos, 'once': once, 'n': n_windows}} ORDER BY pos, bpos) AS hs FROM hm GROUP BY r, item_id),
hb AS (
  SELECT r, item_id, hs, list_transform(range(1, len(hs) + 1), lambda i: CASE
    WHEN i > 1 AND hs[i].pos - hs[i - 1].pos > hs[i].n + {WINDOW} THEN 1
    WHEN i > 1 AND hs[i].once AND hs[i].bpos <= list_last(list_filter(hs[1:i - 1], lambda x: x.once)).bpos THEN 1 ELSE 0 END) AS breaks FROM hl),
hc AS (SELECT r, item_id, unnest(hs, recursive := true), unnest(list_transform(range(1, len(hs) + 1), lambda i: list_sum(breaks[1:i]))) AS chain FROM hb),
cs AS (SELECT r, item_id, chain, count(DISTINCT bpos) AS c, min(pos) AS first FROM hc GROUP BY r, item_id, chain, n HAVING count(DISTINCT bpos) >= {COVERAGE} * n),
su AS (
  SELECT hc.r, hc.item_id, -c * 4294967296 + first AS turn, pos - bpos AS shift, min(bpos) AS lo, max(bpos) AS hi
  FROM hc JOIN cs ON cs.r = hc.r AND cs.item_id = hc.item_id AND cs.chain = hc.chain WHERE once GROUP BY ALL
  UNION ALL SELECT r, item_id, {FIRST}, shift, lo, hi FROM bs WHERE k = 1),
ms AS (SELECT mt.*, shift, lo, hi, turn FROM mt JOIN su ON su.r = mt.r AND su.item_id = mt.item_id),
ex AS (
  SELECT ms.r, ms.item_id, turn, shift, item_text, text, bi.tk AS bt, dk.tk AS dt, unnest(range(lo, hi + {WINDOW})) AS k
  FROM ms JOIN bi ON bi.item_id = ms.item_id JOIN dk ON dk.r = ms.r),
sl AS ({' UNION ALL '.join(map(_slots_sql, SLOTS))}),
sg AS (
  SELECT r, item_id, turn, kind, b, count(*) AS n, count(DISTINCT d) AS nd, sum(CAST(b <> d AS INTEGER)) AS changed
  FROM sl GROUP BY ALL),
st AS (
  SELECT r, item_id, turn, CAST(sum(n) AS BIGINT) AS n_slots, CAST(sum(changed) AS BIGINT) AS n_changed, max(nd) AS nd
  FROM sg GROUP BY ALL),
tp AS (
  SELECT ms.doc_id, ms.item_id, n_windows, n_matched, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed,
    row_number() OVER (PARTITION BY ms.doc_id, ms.item_id ORDER BY n_matched DESC, ms.turn, n_slots, n_changed) AS k
  FROM (SELECT DISTINCT {_PAIR}, n_windows, n_matched, turn FROM ms) ms
  LEFT JOIN st ON st.r = ms.r AND st.item_id = ms.item_id AND st.turn = ms.turn WHERE coalesce(nd, 1) <= 1),
bl AS (SELECT item_id, {_WORDS % "text"} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bz AS (SELECT *, least(len(ws), {LITERAL}) AS z FROM bl WHERE len(ws) > 1 OR (len(ws) = 1 AND length(ws[1]) >= {LONG_WORD})),
bg AS (
  SELECT DISTINCT item_id, z, array_to_string(ws[p + 1:p + z], ' ') AS w
  FROM (SELECT *, unnest(range(0, len(ws) - z + 1)) AS p FROM bz)),
dl AS (SELECT r, doc_id, {_WORDS % "text"} AS ws FROM dk),
dz AS (SELECT *, unnest((SELECT list(DISTINCT z) FROM bz)) AS z FROM dl),
dg AS (
  SELECT DISTINCT r, doc_id, z, array_to_string(ws[p + 1:p + z], ' ') AS w
  FROM (SELECT *, unnest(range(0, len(ws) - z + 1)) AS p FROM dz WHERE len(ws) >= z)),
lt AS (
  SELECT doc_id, item_id, max(n) AS n_literal
  FROM (SELECT {_PAIR}, count(*) AS n FROM dg JOIN bg USING (z, w) GROUP BY ALL) GROUP BY ALL),
tq AS (SELECT * FROM tp WHERE k = 1)
SELECT coalesce(tq.doc_id, lt.doc_id) AS doc_id, coalesce(tq.item_id, lt.item_id) AS item_id,
  coalesce(n_windows, 0) AS n_windows, coalesce(n_matched, 0) AS n_matched,
  coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed, coalesce(n_literal, 0) AS n_literal
FROM tq FULL JOIN lt ON tq.doc_id IS NOT DISTINCT FROM lt.doc_id AND tq.item_id = lt.item_id
"""
