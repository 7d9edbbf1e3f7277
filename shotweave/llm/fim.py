"""Fill-in-the-middle: whole texts cut at units, which a Fenwick tree over fixed blocks of bytes finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, text_buffers, text_or_empty
from .packed import CHUNK

#: Bytes of a block, and bytes that are looked at together (a multiple of it).
BLOCK, AT_ONCE = 512, 1 << 22
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: They come before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")


def _leads(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


class BlockTree:
    """How many units end and how many code points begin in each fixed block of a text, in a Fenwick tree: node i holds the
    sums of the blocks (i - lowest bit of i, i]. A unit is a line with its line break, or a code point."""

    def __init__(self, data: np.ndarray, unit: str = "line"):
        if unit not in UNITS:
            raise ValueError(f"unit {unit!r}: one of {UNITS}")
        self.data, self.unit = data, unit
        self.blocks = -(-len(data) // BLOCK)
        tree = np.zeros((self.blocks + 1, 2), np.int64)
        for at in range(0, len(data), AT_ONCE):
            end = min(at + AT_ONCE, len(data))
            edges, mine = np.arange(0, end - at, BLOCK), slice(1 + at // BLOCK, 1 + -(-end // BLOCK))
            tree[mine, 0] = np.add.reduceat(self._ends(at, end), edges, dtype=np.int64)
            tree[mine, 1] = np.add.reduceat(_leads(data[at:end]), edges, dtype=np.int64)
        self.units, self.chars = tree.sum(axis=0).tolist()
        step = 1
        while step <= self.blocks:
            whole = tree[2 * step :: 2 * step]
            whole += tree[step :: 2 * step][: len(whole)]
            step *= 2
        self.tree = tree

    def _ends(self, at: int, end: int) -> np.ndarray:
        """Which of the bytes from ``at`` to ``end`` end a unit."""
        if self.unit == "char":
            return np.append(_leads(self.data[at + 1 : end]), end == len(self.data) or bool(_leads(self.data[end : end + 1])[0]))
        ends = self.data[at:end] == 10
        if end == len(self.data):
            ends[-1] = True
        return ends

    def after(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the place after ``k`` units: binary lifting finds the block where the k-th unit ends,
        a look at that block's bytes the place."""
        if k <= 0:
            return 0, 0
        block, units, chars = 0, 0, 0
        step = 1 << self.blocks.bit_length() - 1
        while step:
            node = block + step
            if node <= self.blocks and units + self.tree[node, 0] < k:
                block, units, chars = node, units + int(self.tree[node, 0]), chars + int(self.tree[node, 1])
            step //= 2
        at = block * BLOCK
        local = int(np.flatnonzero(self._ends(at, min(at + BLOCK, len(self.data))))[k - units - 1]) + 1
        return at + local, chars + int(np.count_nonzero(_leads(self.data[at : at + local])))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that a document's id fixes."""
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: np.ndarray, h: list[int], unit: str, rate: int, suffix_first: int, marks: tuple[bytes, ...]) -> tuple:
    """(units, form, code points of prefix and middle, output) of a text's bytes."""
    raw, tree = text.tobytes(), BlockTree(text, unit)
    if not raw or any(m in raw for m in marks) or h[2] % 100 >= rate:
        return tree.units, "plain", None, None, raw
    low, high = sorted((h[0] % (tree.units + 1), h[1] % (tree.units + 1)))
    (a, a_chars), (b, b_chars) = tree.after(low), tree.after(high)
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        form, parts = "spm", (s, raw[b:], p, raw[:a], m, raw[a:b])
    else:
        form, parts = "psm", (p, raw[:a], s, raw[b:], m, raw[a:b])
    return tree.units, form, a_chars, b_chars - a_chars, b"".join(parts)


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "line", marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Cut each whole text in prefix, middle and suffix at two random units, and put the middle last.

    Returns one row per row of ``docs``: doc_id, n (units of the text), form ("psm": prefix, suffix, middle; "spm": suffix,
    prefix, middle; "plain": the text as it is), prefix_chars and middle_chars (code points; null if plain), output. Of 100
    texts ``rate`` are cut, and of these ``suffix_first`` begin with the suffix. Cuts and forms hang on ``seed`` and doc_id alone, so a
    repeated task repeats them, and rows that repeat a doc_id draw the same numbers.

    A null text counts as empty. Empty texts and texts that contain a mark stay plain, so that :func:`restored` is exact.
    A null doc_id draws as the word ``null``. Texts of any length are cut whole; a task holds one text and its output at a
    time besides an Arrow batch, and 1/32 of its size for the tree. An empty table gives an empty one. Extra columns, of whatever name, are not read.
    """
    if len(set(marks)) < 3 or any(not m or any(m[:i] == m[-i:] for i in range(1, len(m))) or any(m in o for o in marks if o != m) for m in marks):
        raise ValueError("marks must differ, be no part of each other, and not end as they begin")
    coded = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                cut = [rearranged(data[offsets[i] : offsets[i + 1]], draws(seed, ids[i].as_py()), unit, rate, suffix_first, coded) for i in range(a, b)]
                n, form, prefix, middle, out = zip(*cut)
                arrays = [ids[a:b], pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text of an output and its form. No part has a mark, and none arises where a part meets one."""
    p, s, m = marks
    first, second, third = (F.locate(x, output) for x in (p, s, m))
    last = F.substr(output, third + len(m))
    psm = F.concat(F.substr(output, F.lit(1 + len(p)), second - 1 - len(p)), last, F.substr(output, second + len(s), third - second - len(s)))
    spm = F.concat(F.substr(output, first + len(p), third - first - len(p)), last, F.substr(output, F.lit(1 + len(s)), first - 1 - len(s)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x,
    CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
    array_to_string(u[greatest(x, y) + 1:], '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
