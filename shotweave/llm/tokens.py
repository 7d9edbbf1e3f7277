"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, text_or_empty

# The pattern by which this vocabulary's library splits texts before merging.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces of which every beginning is one piece as well.
EVEN = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")

#: Texts above this many tokens are over the limit.
LIMIT = 1024
#: Pieces whose counts a worker remembers; then it forgets them all.
REMEMBERED = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes of a piece by dynamic programming.

    The last token of a prefix is the one suffix that is a token and may follow the last token of what
    is before it; so count[i] = count[i - len(token)] + 1. Two tokens may follow each other if merging
    their joined bytes gives these two again.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[bytes, bytes], int], special: list[str]):
        self.vocabulary, self.merges = vocabulary, merges
        self.reach: dict[bytes, int] = {}  # the longest token that ends in these two bytes
        for token in vocabulary:
            self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 1))
        self.piece = regex.compile(PIECE)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._total: dict[str, int] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain byte pair merging, lowest rank first: used once for each pair of tokens that meet."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.merges.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        if (known := self._fits.get((left, right))) is None:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            known = self._fits[left, right] = self.merge(left + right) == [left, right]
        return known

    def prefixes(self, data: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes of one piece, for every i."""
        counts, last = [0], [b""]
        vocabulary, reach, known = self.vocabulary, self.reach, self._fits
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - reach.get(data[max(0, end - 2) : end], 1)), end):
                token = data[start:end]
                if token in vocabulary and (not start or known.get((last[start], token)) or self.fits(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return counts

    def _plain(self, text: str) -> int:
        memo, total = self._total, 0
        for p in self.piece.findall(text):
            if (n := memo.get(p)) is None:
                if len(memo) > REMEMBERED:
                    memo.clear()
                n = self.prefixes(p.encode())[-1]
                if len(p) < 64:
                    memo[p] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string counts as that one token."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        plain = self.special.split(text)
        return sum(map(self._plain, plain)) + len(plain) - 1


class PrefixTable:
    """Counts at every prefix of one text; prefixes are measured in characters.

    A prefix may end inside a piece, a white-space run or a special token's string, and then splits
    differently from the whole text. What a prefix adds after the last complete piece before its end
    is split anew, so the count is that of the prefix encoded alone; within a long piece of one kind
    of characters it is looked up among the piece's own prefix counts.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.starts, self.before, total, at = [], [], 0, 0
        self.stops: set[int] = set()  # pieces that are special tokens
        stops = [m.span() for m in counter.special.finditer(text)] if counter.special else []
        for begin, end in [*stops, (len(text), len(text))]:
            for m in counter.piece.finditer(text[at:begin]):
                self.starts.append(at + m.start())
                self.before.append(total)
                total += counter.prefixes(m[0].encode())[-1]
            if end > begin:
                self.stops.add(len(self.starts))
                self.starts.append(begin)
                self.before.append(total)
                total += 1
            at = end
        self.total = total
        self._piece: tuple[int, list[int] | None] = (-1, None)

    def _within(self, k: int) -> list[int] | None:
        """The counts of the beginnings of piece k, by characters, if all of these are pieces; of the last piece asked for."""
        if self._piece[0] != k:
            end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
            piece, counts = self.text[self.starts[k] : end], None
            # A contraction splits otherwise before its letters; marks alone don't.
            if k not in self.stops and EVEN.fullmatch(piece) and not (piece.startswith("'") and piece[1:2].isalpha()):
                of_bytes, counts, at = self.counter.prefixes(piece.encode()), [0], 0
                for char in piece:
                    at += len(char.encode())
                    counts.append(of_bytes[at])
            self._piece = k, counts
        return self._piece[1]

    def at(self, n_chars: int) -> int:
        if n_chars >= len(self.text):
            return self.total
        k = bisect_right(self.starts, n_chars) - 1
        if k < 0:
            return 0
        begin = self.starts[k]
        if begin == n_chars and k:
            k -= 1
            begin = self.starts[k]
        if k in self.stops or (self.text[n_chars - 1 : n_chars].isspace() and self.text[begin:n_chars].isspace()):
            while k > 0 and self.text[self.starts[k] - 1 : self.starts[k]].isspace():
                k -= 1  # a run of white space splits by what follows it
            begin = self.starts[k]
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        if n_chars <= end and (counts := self._within(k)) is not None:
            return self.before[k] + counts[n_chars - begin]
        return self.before[k] + self.counter.count(self.text[begin:n_chars])

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, found among the prefixes themselves."""
        if self.total <= budget:
            return len(self.text)
        k = bisect_right(self.before, budget) - 1
        # Within a piece a longer prefix may have fewer tokens, so all prefixes of this piece and the next are tried.
        far = self.starts[k + 2] if k + 2 < len(self.starts) else len(self.text)
        return next((n for n in range(far, self.starts[max(k - 1, 0)] - 1, -1) if self.at(n) <= budget), 0)


@lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    """The counter for a vocabulary file of the tokenizers library (byte-level BPE)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    raw = lambda token: bytes(letter[c] for c in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    special = [t["content"] for t in spec["added_tokens"]]
    vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return PrefixCounter(vocabulary, {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}, special)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text, in one pass without a shuffle.

    Returns one row per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``). Null texts
    count as empty (0 tokens); a null doc_id is kept; repeated rows give repeated rows; extra columns
    are not read; an empty table gives an empty one. Texts are counted whole, one after the other. ``vocabulary_path`` must exist on the executors, as an installed package does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary_path)
        for batch in batches:
            ids, texts = batch.columns
            n_bytes, n_tokens = [], []
            for text in texts:
                text = text.as_py()
                n_bytes.append(len(text.encode()))
                n_tokens.append(counter.count(text))
            over = [n > limit for n in n_tokens]
            told = [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())]
            yield pa.RecordBatch.from_arrays(told, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def truncation_points(docs: DataFrame, vocabulary_path: str, budgets: list[int]) -> DataFrame:
    """For every text and token budget, the longest prefix that keeps within it: doc_id, budget, n_chars,
    n_tokens (of that prefix). Every answer comes from the text's prefix table. Nulls as in token_counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary_path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = PrefixTable(counter, text)
                for budget in budgets:
                    n = table.longest_within(budget)
                    out.append((doc_id, budget, n, table.at(n)))
            fields = list(zip(*out)) or [(), (), (), ()]
            kinds = batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64()
            told = [pa.array(x, kind) for x, kind in zip(fields, kinds)]
            yield pa.RecordBatch.from_arrays(told, ["doc_id", "budget", "n_chars", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, budget int, n_chars long, n_tokens long")
