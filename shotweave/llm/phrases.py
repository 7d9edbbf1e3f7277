"""Collocations: phrases that occur often and hang together, counted with an index for each shard of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, mix, stored, text_buffers, text_or_empty
from .packed import batch_of, cut_by_bucket, dealt, small, wide

#: Words of the longest phrase, least number of occurrences, percent of them in a longer phrase that make a shorter one redundant, and phrases listed of each language.
MOST_WORDS, LEAST, COVERED, TOP, FACTOR = 5, 100, 100, 2000, 1000
#: Words of a shard, about, words that a task holds of all languages, and bytes of a text that are split at a time.
SHARD, HELD, SLICE = 2_000_000, 5_000_000, 1 << 22
#: Words of the corpus for each part of the phrases that are counted together.
PART = 4_000_000
#: Bits of the number of a shard within its task, and of the place in a shard.
NUMBER, PLACE = 16, 27
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


# --- the index of a shard ---------------------------------------------------------------------------
class _Words(dict):
    """Numbers for words in the order in which they come, from 1; 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a line break after each piece and empty ones between, in slices that end with a piece."""
    text = text.lower().translate(_PIECES)  # bytes.lower() knows ASCII only
    at = 0
    while at < len(text):
        end = text.rfind(b"\n", at, at + SLICE) + 1 if len(text) - at > SLICE else len(text)
        if end <= at:
            end = text.find(b"\n", at + SLICE) + 1 or len(text)
        yield [*text[at:end].replace(b"\n", b" \n ").split(b" "), b"\n"]
        at = end


def numbered(tokens: list[bytes], numbers: _Words) -> np.ndarray:
    """Numbers of words, with a 0 after each piece that has words."""
    found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    found = found[found >= 0]
    return found[(found > 0) | np.append(False, found[:-1] > 0)]


def transform(words: np.ndarray, depth: int) -> np.ndarray:
    """Burrows-Wheeler transform of numbers that end with 0, suffixes being in the order of their first ``depth`` numbers only:
    the number before each suffix. Ranks of 1, 2, 4, ... numbers are built from each other."""
    rank, span = words.astype(np.int64), 1
    order = np.argsort(rank)
    while span < depth:
        step = min(span, depth - span)
        key = rank * (int(rank.max()) + 1)
        key[:-step] += rank[step:]
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        span += step
    return words[order - 1]  # before the first comes the last, a 0


class Intervals(NamedTuple):
    """Phrases of one length in a shard as intervals of both transforms: ``n`` suffixes from ``low`` on begin with the phrase, as many prefixes
    from ``back`` on, in the order of the reversed text, end with it. ``name`` has their names over all shards."""

    name: np.ndarray
    low: np.ndarray
    back: np.ndarray
    n: np.ndarray


def extended(bwt: np.ndarray, known: Intervals) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extend phrases by each word that comes before them: phrase (its place in ``known``), low, back, n of each longer one, and of
    those with the end of a piece before them. Given the transform of the reversed text, and low and back exchanged, the words come behind.

    The words before a phrase are those of its interval in the transform; the interval of the longer phrase begins after the words
    that are less, and so many equal ones as come before the phrase's own. In the other transform it lies within the phrase's own
    interval, after those of lesser words."""
    n, m = len(bwt), int(bwt.max()) + 1
    of = np.repeat(np.arange(len(known.n)), known.n)
    place = np.arange(len(of)) + np.repeat(known.low - np.cumsum(known.n) + known.n, known.n)
    key, count = np.unique(of * m + bwt[place], return_counts=True)
    phrase, word = np.divmod(key, m)
    less = np.cumsum(count) - count
    back = known.back[phrase] + less - less[np.searchsorted(phrase, np.arange(len(known.n)))][phrase]
    ranks = np.sort(bwt.astype(np.int64) * n + np.arange(n))  # the places of each word, in order
    return phrase, np.searchsorted(ranks, word * n + known.low[phrase]), back, count


def within(low: np.ndarray, n: np.ndarray, outer_low: np.ndarray, outer_n: np.ndarray) -> np.ndarray:
    """Which of the outer intervals, which don't overlap, holds each interval; -1 for none."""
    order = np.argsort(outer_low)
    at = np.searchsorted(outer_low[order], low, "right") - 1
    inside = (at >= 0) & (low + n <= (outer_low + outer_n)[order[at]])
    return np.where(inside, order[at], -1)


# --- shards and rounds ------------------------------------------------------------------------------
def shards(docs: DataFrame, depth: int, most: int = SHARD, held: int = HELD) -> DataFrame:
    """The corpus in shards of one language and about ``most`` words: shard, lang, size, words and counts (arrays: distinct words in the
    order of their numbers, from 1), forward and backward (transforms of the numbers and of the reversed numbers)."""
    names = ["shard", "lang", "size", "words", "counts", "forward", "backward"]
    kinds = pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Words] = {}
        parts: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        made = iter(range(TaskContext.get().partitionId() << NUMBER, TaskContext.get().partitionId() + 1 << NUMBER))

        def shard_of(lang: str) -> Iterator[pa.RecordBatch]:
            spelled = [w for w in numbers.pop(lang) if w not in (b"", b"\n")]
            text = np.concatenate(parts.pop(lang))
            if not sizes.pop(lang):
                return
            if len(text) >= 1 << PLACE:
                raise ValueError(f"a piece of over {1 << PLACE} words")
            counts = np.bincount(text)[1:]
            both = [small(transform(x, depth)) for x in (text, np.append(text[-2::-1], 0).astype(np.int32))]
            batch = batch_of([[next(made)], [lang], [int(counts.sum())], [spelled], [counts.tolist()], *[[x] for x in both]], names, *kinds)
            yield batch.set_column(3, "words", batch.column(3).cast(pa.list_(pa.string())))

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for i, lang in enumerate(langs):
                for tokens in tokens_of(data[offsets[i] : offsets[i + 1]].tobytes()):
                    part = numbered(tokens, numbers.setdefault(lang, _Words()))
                    parts.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    for full in [lang] if sizes[lang] >= most else list(sizes) if sum(sizes.values()) >= held else []:
                        yield from shard_of(full)
        for lang in list(sizes):
            yield from shard_of(lang)

    rows = columns(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return rows.where("text <> ''").mapInArrow(run, "shard long, lang string, size long, words array<string>, counts array<bigint>, forward binary, backward binary")


def _frequent_words(all_shards: DataFrame, least: int) -> DataFrame:
    """Words that occur often enough in all shards of a language together, a row for each shard that has one: shard, low (the word's number there), back, n
    (occurrences there), f (in all), name (the least shard that has it and its number there: the same in all shards, and no other word's), first
    (whether the row is the one that gave the name), lang, word."""
    words = all_shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    number = (F.col("at") + 1).cast("long")
    words = words.select("shard", "lang", F.col("w.words").alias("word"), number.alias("low"), F.lit(0).cast("long").alias("back"), F.col("w.counts").alias("n"))
    everywhere = Window.partitionBy("lang", "word")
    place = F.shiftleft("shard", PLACE).bitwiseOR(F.col("low"))
    told = words.withColumn("place", place).withColumns({"f": F.sum("n").over(everywhere), "name": F.min("place").over(everywhere)})
    return told.where(F.col("f") >= least).withColumn("first", F.col("place") == F.col("name")).drop("place")


_LONGER = ["one", "two", "low", "back", "n"]


def _packed(columns: list[np.ndarray], edges: np.ndarray, some: list[int]) -> list[pa.Array]:
    """Some stretches of each column, packed."""
    return [pa.array([small(np.diff(x[edges[k] : edges[k + 1]], prepend=np.int64(0))) for k in some], pa.binary()) for x in columns]


def _unpacked(column: list[bytes]) -> np.ndarray:
    return np.concatenate([np.cumsum(wide(x)) for x in column])


def _longer(index: DataFrame, known: DataFrame, ahead: bool, of_words: bool, parts: int) -> DataFrame:
    """Extend the frequent phrases of each shard (``known``: shard, name, low, back, n) by one word, in front if ``ahead``, else behind, and keep
    what has two frequent ends: part, shard and, packed in arrays, one, two (names of the phrase without its last and without its first word), low, back, n. A phrase
    is of the same part in all shards. ``index``: shard, bwt. For phrases ``of_words``, which are words, a row has one of them, and low is its
    number; for others, it has arrays of them."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), *[(c, pa.binary()) for c in _LONGER]])

    def extend(index: pa.Table, known: pa.Table) -> pa.Table:
        if not index.num_rows or not known.num_rows:
            return schema.empty_table()
        shard, bwt = index.column("shard")[0].as_py(), wide(index.column("bwt")[0].as_py())
        name, low, back, n = (known.column(c).to_numpy() if of_words else _unpacked(known.column(c).to_pylist()) for c in Intervals._fields)
        if of_words:
            low = back = np.append(0, np.cumsum(np.bincount(bwt)))[low]
        own = Intervals(name, low, back, n) if ahead else Intervals(name, back, low, n)
        phrase, low, back, n = extended(bwt, own)
        other = within(low, n, own.low, own.n)  # the end that has the new word
        on = other >= 0
        one, two = [name[other[on]], name[phrase[on]]][:: 1 if ahead else -1]
        low, back = [low[on], back[on]][:: 1 if ahead else -1]
        place, edges = cut_by_bucket((mix(mix(one.astype(np.uint64)) ^ two.astype(np.uint64)) % np.uint64(parts)).astype(np.int64), parts)
        some = np.flatnonzero(np.diff(edges)).tolist()
        packed = _packed([x.astype(np.int64)[place] for x in (one, two, low, back, n[on])], edges, some)
        return pa.table([pa.array(some, pa.int32()), pa.array([shard] * len(some), pa.int64()), *packed], schema=schema)

    known = known.select("shard", *Intervals._fields)
    grouped = index.groupBy("shard").cogroup(known.groupBy("shard"))
    return grouped.applyInArrow(extend, "part int, shard long, " + ", ".join(f"{c} binary" for c in _LONGER))


def _frequent(packed: DataFrame, least: int) -> DataFrame:
    """Sum up over the shards what :func:`_longer` has counted and keep what occurs often enough. Rows of two kinds: for each shard, in arrays, name, low, back, n of its
    phrases; and for each phrase (the others null) its name, as phrase, one, two and f. A part holds the counts of its phrases only."""
    kinds = {"shard": pa.int64(), **{c: pa.binary() for c in Intervals._fields}, **{c: pa.int64() for c in ("phrase", "one", "two", "f")}}

    def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in kinds.items()], list(kinds))

    def judge(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        one, two, low, back, n = (_unpacked([r[i] for r in held]) for i in range(1, 6))
        shard = np.repeat([r[0] for r in held], [int.from_bytes(r[1][1:9], "little") for r in held])
        order = np.lexsort((one, two))
        one, two, low, back, n, shard = (x[order] for x in (one, two, low, back, n, shard))
        starts = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        sizes = np.diff(np.append(starts, len(one)))
        f, name = np.add.reduceat(n, starts), np.minimum.reduceat(shard << PLACE | low, starts)
        often = f >= least
        yield batch({c: pa.array(x[often]) for c, x in (("phrase", name), ("one", one[starts]), ("two", two[starts]), ("f", f))})
        on = np.repeat(often, sizes)
        shards, which = np.unique(shard[on], return_inverse=True)
        place, edges = cut_by_bucket(which, max(1, len(shards)))
        columns = _packed([x[on][place] for x in (np.repeat(name, sizes), low, back, n)], edges, list(range(len(shards))))
        yield batch({"shard": pa.array(shards), **dict(zip(Intervals._fields, columns))})

    return dealt(packed, "part", ["shard", *_LONGER], ", ".join(f"{c} {'binary' if t == pa.binary() else 'long'}" for c, t in kinds.items()), judge)


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """All phrases of 2 to ``most_words`` words that occur ``least`` times or more in the texts of a language, and how well they hang together.

    Texts have A-Z in lower case and are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; a null lang is
    ``und``, a null text empty. Every occurrence within a piece counts, overlapping ones and those of repeated rows too. Returns lang, phrase (joined by spaces),
    n_words, a (occurrences), l, r (of its two parts), n (words of the language), score (1000 * a * n / (l * r), rounded down, for the cut in two where it is least; of equal ones the
    first), left, right (occurrences of its most frequent extension by a word in front and behind; 0 below ``least``, and
    for the longest). An empty table gives an empty one. Extra columns are not read, nor is doc_id.

    Each shard has its index in both directions; a phrase is an interval of it and is extended by a LF step, in front and behind in turns. In each round the shards count the
    phrases that are one word longer and whose two ends are frequent in all shards together, the counts are summed up by parts of the phrases, and
    the frequent ones go back to the shards that have them. So what is shipped is a count for each shard and phrase, never
    one for each occurrence, in packed rows; phrases are told apart by the names of their ends, not by hashes. A piece may have 134 million words."""
    all_shards = stored(shards(docs, max(1, most_words - 1), shard, 5 * shard // 2), "shards")
    n_words = all_shards.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-n_words // PART))
    known = stored(_frequent_words(all_shards, least), "frequent-1")
    none = F.array().cast("array<bigint>")
    grams = known.where("first").select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("prefixes"), none.alias("suffixes"))
    found: list[DataFrame] = []
    for size in range(2, most_words + 1):
        ahead = size % 2 == 0
        index = all_shards.select("shard", F.col("forward" if ahead else "backward").alias("bwt"))
        told = stored(_frequent(_longer(index, known, ahead, size == 2, parts), least), f"frequent-{size}")
        known, named = told.where("shard IS NOT NULL"), told.where("phrase IS NOT NULL").select(F.col("phrase").alias("name"), "one", "two", "f")
        right = named.groupBy(F.col("one").alias("name")).agg(F.max("f").alias("right"))
        left = named.groupBy(F.col("two").alias("name")).agg(F.max("f").alias("left"))
        if size > 2:
            found.append(grams.join(left, "name", "left").join(right, "name", "left"))
        one = grams.select(F.col("name").alias("one"), "lang", F.col("phrase").alias("begin"), F.array_append("prefixes", F.col("f")).alias("prefixes"))
        two = grams.select(F.col("name").alias("two"), "last", F.array_append("suffixes", F.col("f")).alias("suffixes"))
        grams = named.join(one, "one").join(two, "two").select("name", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "prefixes", "suffixes")
        grams = stored(grams, f"phrases-{size}")
    zero = F.lit(0).cast("long")
    found.append(grams.select("*", zero.alias("left"), zero.alias("right")) if most_words > 1 else grams.limit(0).select("*", zero.alias("left"), zero.alias("right")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    sizes = all_shards.groupBy("lang").agg(F.sum("size").alias("n"))
    cut = F.expr(
        f"""array_min(transform(sequence(1, size(prefixes)), k -> named_struct(
        'score', CAST({FACTOR} AS DECIMAL(38, 0)) * f * n div (CAST(prefixes[k - 1] AS DECIMAL(38, 0)) * suffixes[size(suffixes) - k]),
        'k', k, 'l', prefixes[k - 1], 'r', suffixes[size(suffixes) - k])))"""
    )
    every = every.join(sizes, "lang").withColumn("cut", cut)
    sides = [F.coalesce(c, zero).alias(c) for c in ("left", "right")]
    return every.select("lang", "phrase", (F.size("prefixes") + 1).alias("n_words"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", *sides)


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """The ``top`` phrases of each language by score, then occurrences (both descending), then phrase in the order of its bytes: the columns
    of :func:`frequent_phrases` and rank, from 1.

    Phrases go whose words lie in a longer frequent phrase with ``covered`` percent of their occurrences or more. Such a longer phrase
    holds one that is a word longer and at least as frequent, so the most frequent extensions decide. Phrases are ranked in parts of a
    language first, so that a language's phrases needn't all meet in one task."""
    every = frequent_phrases(docs, most_words, least, shard)
    every = every.where(F.greatest("left", "right") * 100 < F.col("a") * covered)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top)


def digest(best: DataFrame) -> DataFrame:
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, k WHERE len(ws) >= k),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, any_value(ws[i:i + k - 1]) AS ws, count(*) AS a
  FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 100),
x AS (
  SELECT DISTINCT s.lang, s.phrase
  FROM (SELECT lang, k, ws, a, unnest(range(1, k)) AS size FROM f WHERE k > 2) g, f s
  WHERE s.lang = g.lang AND s.k = g.size AND 100 * g.a >= 100 * s.a
    AND list_contains(list_transform(range(1, g.k - g.size + 2), lambda j: array_to_string(g.ws[j:j + g.size - 1], ' ')), s.phrase)),
u AS (SELECT lang, k, phrase, ws, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
c AS (
  SELECT u.lang, u.phrase, u.a, l.a AS l, r.a AS r, t.n, CAST(1000::HUGEINT * u.a * t.n // (l.a::HUGEINT * r.a) AS BIGINT) AS score, cut
  FROM u JOIN t ON t.lang = u.lang
  JOIN f l ON l.lang = u.lang AND l.k = cut AND l.phrase = array_to_string(u.ws[1:cut], ' ')
  JOIN f r ON r.lang = u.lang AND r.k = u.k - cut AND r.phrase = array_to_string(u.ws[cut + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM c),
z AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM b WHERE turn = 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM x))
SELECT * FROM z WHERE rank <= 2000
"""
