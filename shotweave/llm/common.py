"""What the corpus operators share: intermediate tables, text columns and vectorised word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words, everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir`` or, where the session names none, below its warehouse:
    both are shared by all executors."""
    above = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{above.rstrip('/')}/shotweave-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stored, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exact_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of sides that are dealt alike as dealt, while its adaptive planner may still deal one side
    otherwise: what is aggregated above then sees part of a key's rows, from run to run. Without that assumption the rows
    are shuffled once more."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once in the shared folder and read it back: a lost executor repeats nothing before it. The table
    stays until :func:`clear`, as results are read lazily."""
    exact_unions(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_ids(docs: DataFrame) -> DataFrame:
    """``docs``, whose doc_id must be of an integer type."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"doc_id is {kind.simpleString()}; this operator needs integers: number the documents first")
    return docs


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --- word hashes over Arrow buffers -------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
#: Bytes that are hashed at a time.
SLICE = 1 << 20
_UP, _DOWN = (np.cumprod(np.append(np.uint64(1), np.full(SLICE, x)), dtype=np.uint64) for x in (_BASE, _INVERSE))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_UP):
        return _UP, _DOWN
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x)), dtype=np.uint64) for x in (_BASE, _INVERSE))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all words of texts laid end to end in ``data``; text i is
    ``data[offsets[i]:offsets[i + 1]]``. Returns the hashes and the number of words of each text.

    Bytes are hashed in slices that end with white space or a text, so that besides the result (8 bytes a word) some 40 MB are held, however
    long a text is; a word that is longer than a slice takes 40 bytes for each of its own."""
    data, offsets = data[offsets[0] : offsets[-1]], np.asarray(offsets, np.int64) - offsets[0]
    per_text, parts, at = np.zeros(len(offsets) - 1, np.int64), [], 0
    while at < len(data):
        end = _slice_end(data, offsets, at)
        first, last = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        hashes, n = _hashes_of(data[at:end], np.clip(offsets[first : last + 1], at, end) - at)
        parts.append(hashes)
        per_text[first:last] += n
        at = end
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), per_text


def _slice_end(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where the slice from ``at`` on ends: behind its last white space or text, or else behind the next one."""
    if len(data) - at <= SLICE:
        return len(data)
    space = np.flatnonzero(_IS_SPACE[data[at : at + SLICE]])
    text = int(offsets[np.searchsorted(offsets, at + SLICE, "right") - 1])
    if len(space) or text > at:
        return max(text, at + int(space[-1]) + 1 if len(space) else 0)
    text = int(offsets[np.searchsorted(offsets, at + SLICE, "left")])
    for begin in range(at + SLICE, text, SLICE):
        space = np.flatnonzero(_IS_SPACE[data[begin : min(begin + SLICE, text)]])
        if len(space):
            return begin + int(space[0]) + 1
    return text


def _hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's first byte; empty texts mark the next one's
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text begins."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), at


def chunks(offsets: np.ndarray, most_bytes: int) -> list[tuple[int, int]]:
    """Runs of whole texts of at most so many bytes; a longer text is a run of its own."""
    out, begin, n = [], 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, "right")) - 1)
        out.append((begin, min(end, n)))
        begin = out[-1][1]
    return out
