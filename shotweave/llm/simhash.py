"""SimHash near-duplicates: fingerprints, bit-sliced comparison, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, fresh, mix, stored, text_buffers, text_or_empty, whole_ids, word_hashes
from .packed import CHUNK
from .substring import window_hashes

WORDS, RADIUS = 3, 2
#: Fingerprints of one band value that are compared in one group; more are split in tiles that meet in pairs.
TILE = 1024
#: Shingles whose bits are unpacked at a time.
AT_ONCE = 1 << 16
LANES = 64


def fingerprint(text: str, n_words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles of a text with A-Z in lower case; no words: 0."""
    words = text.encode().lower().split()  # bytes.split() and bytes.lower() know ASCII only
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
    edges = np.concatenate([[0], np.cumsum(sizes)])
    n = max(1, len(words) - n_words + 1)
    begins, ends = edges[:n].tolist(), (edges[min(n_words, len(words)) :][:n] - 1).tolist()
    of, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        h = np.array([of(joined[a:b], 42) for a, b in zip(begins[at : at + AT_ONCE], ends[at : at + AT_ONCE])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of each whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, print long")


# --- bit-sliced comparison -------------------------------------------------------------------------
def bit_planes(prints: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints (n, 64) stored vertically: word p of a block has bit p of all of its fingerprints."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    return packed.view("<u8")[:, :, 0]


def near_lanes(planes: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """For each block of planes (n, 64) and its query's bits as masks (n, 64): the lanes within the radius.

    Differences of all lanes are added at once in carry-save counters of a few bits, which start so that
    more than ``radius`` differences overflow; blocks whose lanes have all overflowed are abandoned.
    """
    n_bits = max(1, int(radius).bit_length())
    start = (1 << n_bits) - 1 - radius
    full = ~np.uint64(0)
    alive = np.arange(len(planes))
    counters = [np.full(len(planes), full if start >> b & 1 else np.uint64(0)) for b in range(n_bits)]
    over = np.zeros(len(planes), np.uint64)
    out = np.zeros(len(planes), np.uint64)
    for p in range(64):
        carry = planes[alive, p] ^ query[alive, p]
        for b in range(n_bits):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if p % 8 == 7 and p < 63:
            on = over != full
            if not on.all():
                alive, over, counters = alive[on], over[on], [c[on] for c in counters]
                if not len(alive):
                    break
    out[alive] = ~over
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(
    sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], radius: int,
    agrees: Callable[[int, np.ndarray], np.ndarray] | None = None, holds: Callable[[int, int], bool] | None = None,
) -> list[tuple[int, int]]:
    """Join fingerprints that are within the radius. ``sides``: for each group, its fingerprints, a side for each (0 and 1
    are compared only across, where there are both; else all with all) and a class: those of one are joined already.
    Returns the new links, places in all groups laid end to end, of which none could be left out.
    ``agrees(i, others)``: which of the others within the radius of i are joined, if not all. ``holds(i, other)``: whether
    one of these is indeed; pairs that are connected already aren't asked for."""
    base, q_blocks, t_blocks, same, blocks, sizes, at = 0, [], [], [], [], [], []
    parent: list[int] = []
    for prints, side, known in sides:
        _, first, place = np.unique(known, return_index=True, return_inverse=True)
        parent += (base + first[place]).tolist()
        parts = [np.flatnonzero(side == s) for s in (0, 1)] if side.any() and not side.all() else [np.arange(len(prints))]
        ranges = []
        for part in parts:
            first = len(blocks)
            for i in range(0, len(part), LANES):
                lanes = part[i : i + LANES]
                blocks.append(np.pad(prints[lanes], (0, LANES - len(lanes))))
                sizes.append(len(lanes))
                at.append(np.pad(base + lanes, (0, LANES - len(lanes))))
            ranges.append(range(first, len(blocks)))
        if len(ranges) == 1:
            pairs = [(a, b) for a in ranges[0] for b in range(a, len(blocks))]
        else:
            pairs = [(a, b) for a in ranges[0] for b in ranges[1]]
        q_blocks += [a for a, _ in pairs]
        t_blocks += [b for _, b in pairs]
        base += len(prints)
    found_links: list[tuple[int, int]] = []
    if not blocks:
        return found_links
    planes, size, at_ = bit_planes(np.array(blocks)), np.array(sizes), np.array(at)
    q_all, t_all = np.array(q_blocks), np.array(t_blocks)
    valid_all = np.where(size[t_all] >= LANES, ~np.uint64(0), (np.uint64(1) << (size[t_all] % LANES).astype(np.uint64)) - np.uint64(1))
    for k in range(int(size.max())):
        rows = np.flatnonzero(size[q_all] > k)
        for lo in range(0, len(rows), 8192):
            mine = rows[lo : lo + 8192]
            q, t, valid = q_all[mine], t_all[mine], valid_all[mine]
            later = ~np.uint64(0) << np.uint64(k) << np.uint64(1) if k < 63 else np.uint64(0)
            valid = np.where(q == t, valid & later, valid)
            on = valid != 0
            q, t, valid = q[on], t[on], valid[on]
            masks = np.uint64(0) - (planes[q] >> np.uint64(k) & np.uint64(1))
            found = near_lanes(planes[t], masks, radius) & valid
            for i in np.flatnonzero(found):
                own = int(at_[q[i], k])
                a = _find(parent, own)
                others = at_[t[i], np.unpackbits(found[i : i + 1].view(np.uint8), bitorder="little").astype(bool)]
                others = [x for x in others.tolist() if _find(parent, x) != a]
                if agrees and others:
                    others = np.array(others)[agrees(own, np.array(others))].tolist()
                for x in others:
                    b = _find(parent, x)
                    if holds and (a == b or not holds(own, x)):
                        continue
                    if a == b:
                        continue
                    found_links.append((own, x))
                    a, b = min(a, b), max(a, b)
                    parent[b] = a
    return found_links


def band_keys(radius: int = RADIUS) -> Column:
    """Keys of which any two fingerprints within the radius share one: the fingerprint in radius + 2 blocks of bits,
    and of these any 2 together; at most ``radius`` blocks differ."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("print", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    return F.array(*[F.struct(F.lit(k).alias("band"), block[i].alias("x"), block[j].alias("y")) for k, (i, j) in enumerate(combinations(range(n), 2))])


def rest_keys() -> Column:
    """For each of the pairs of blocks of :func:`band_keys` at radius 2, keys of the other two blocks: cut in four, any
    2 parts together. Fingerprints within 2 bits differ in at most two of the four parts, so they share one of these."""
    told = []
    for i, j in combinations(range(4), 2):
        others = [b for b in range(4) if b not in (i, j)]
        part = [F.shiftrightunsigned("print", 16 * b + at).bitwiseAND(F.lit(255)) for b in others for at in (0, 8)]
        told.append(F.array(*[F.shiftleft(F.shiftleft(part[x], 8) + part[y], 4) + k for k, (x, y) in enumerate(combinations(range(4), 2))]))
    return F.array(*told)


GROUP = ["band", "x", "y", "z", "t", "u"]


def _links(rows: DataFrame, radius: int, similarity: float | None, exact: float | None) -> DataFrame:
    """Links (a, b) that connect what fingerprints within the radius connect in each GROUP of ``rows``: GROUP, side, cls (a
    class in which nodes are connected already), node, print, sketch and, for ``exact``, shingles. Links are as few as
    connect what they connect."""
    first = len(GROUP) + 2  # the place of node

    def compare(part: np.ndarray, sketches: np.ndarray, sets: list[bytes]) -> pa.RecordBatch:
        def agrees(i: int, others: np.ndarray) -> np.ndarray:
            return sketch_similarity(sketches[i], sketches[others]) >= similarity

        def holds(i: int, other: int) -> bool:
            return jaccard(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[other], np.uint64)) >= exact - 1e-9

        group = part[:, : len(GROUP)]
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        sides = [(g[:, first + 1].view(np.uint64), g[:, first - 2], g[:, first - 1]) for g in np.split(part, cuts)]
        found = linked(sides, radius, agrees if similarity else None, holds if exact is not None else None)
        a, b = (part[[link[k] for link in found], first] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray, list[bytes]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.column_stack([np.asarray(c).astype(np.int64) for c in batch.columns[: first + 2]])
            sketches = np.frombuffer(b"".join(batch.column(first + 2).to_pylist()), np.uint8).reshape(len(part), -1)
            sets = batch.column(first + 3).to_pylist() if exact is not None else []
            if rest:
                part, sketches, sets = np.concatenate([rest[0], part]), np.concatenate([rest[1], sketches]), rest[2] + sets
            last = np.flatnonzero((part[:, : len(GROUP)] != part[-1, : len(GROUP)]).any(axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            rest = part[whole:], sketches[whole:], sets[whole:]
            if whole:
                yield compare(part[:whole], sketches[:whole], sets[:whole])
        if rest:
            yield compare(*rest)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*GROUP, "side", "cls", "node", "print", "sketch", *["shingles"] * (exact is not None))
    return rows.repartition(n, *GROUP).sortWithinPartitions(*GROUP, "side", "node").mapInArrow(run, "a long, b long")


def _tile(of: Column) -> Column:
    return F.pmod(F.xxhash64("node", "band"), of).cast("int")


def _large_classes(rows: DataFrame, key: list[str], tile: int) -> DataFrame:
    """For each key with nodes outside of its largest class (cls): major (that class), and in how many tiles its nodes and
    the others come."""
    sizes = rows.groupBy(*key, "cls").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy(*key).agg(F.max_by("cls", F.struct("c", "cls")).alias("major"), F.max("c").alias("n_major"), F.sum("c").alias("n"))
    tiles = lambda n: F.ceil(n / tile).cast("int")
    others = F.col("n") - F.col("n_major")
    return sizes.where("n > n_major").select(*key, "major", tiles(F.col("n_major")).alias("majors"), tiles(others).alias("minors"))


def connected(keyed: DataFrame, radius: int = RADIUS, similarity: float | None = None, tile: int = TILE, exact: float | None = None) -> DataFrame:
    """What fingerprints within the radius connect: node, root (the smallest one reachable) of each node with a link.
    ``keyed``: band int, x long, y long (a key: only nodes that share one are compared), node long, print long, sketch
    binary; each node once for a key. With a ``similarity``, the sketches must agree that well too; with ``exact``,
    ``keyed`` has a column shingles too (of ``sketched``), whose Jaccard similarity must reach it.

    Keys of one node go. Keys of up to ``tile`` nodes are a group; those of more are dealt in tiles, differently for each
    band, and each tile is linked on its own. By then most nodes of a large class are connected, and what is left to do
    for a large key is to compare the nodes outside of its largest class with each other and with that class: tiles of the
    class meet tiles of the others only. If ``keyed`` has a column finer (array<long>), two nodes of such a key that may be
    linked share one of these too; where the others are more than a tile, only nodes that do are compared. The work on a
    key is so many comparisons as it has nodes times nodes outside of its largest class that share a finer key."""
    key = ["band", "x", "y"]
    many = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = stored(many, "keys")
    zero = F.lit(0).cast("long")
    own = _tile(F.ceil(F.col("n") / tile)).alias("t")
    rows = keyed.drop("finer").join(many, key).select("*", zero.alias("z"), own, F.lit(0).alias("u"), F.lit(0).alias("side"), F.col("node").alias("cls"))
    roots = stored(components(_links(rows, radius, similarity, exact)), "roots")
    large = many.where(F.col("n") > tile)
    if large.isEmpty():
        return roots

    rows = keyed.join(large.drop("n"), key).join(roots, "node", "left").withColumn("cls", F.coalesce("root", "node")).drop("root")
    rows = stored(rows, "large-keys")
    sizes = stored(_large_classes(rows, key, tile), "large-classes")
    if "finer" in keyed.columns:
        # Where the others fit in one tile, they meet the class at the cost of its size; only beyond, keys are made finer.
        few = sizes.where("minors = 1")
        plain = rows.drop("finer").withColumn("z", zero).join(few, key)
        fine = rows.join(sizes.where("minors > 1").select(*key), key).select(*key, "node", "cls", F.explode("finer").alias("z"))
        fine = stored(fine, "finer-keys")
        finest = stored(_large_classes(fine, [*key, "z"], tile), "finer-classes")
        # What a node brings along is joined only where there is something left to compare.
        fine = fine.join(finest, [*key, "z"]).join(rows.drop("cls", "finer"), [*key, "node"])
        rows = plain.unionByName(fine)
    else:
        rows = rows.withColumn("z", zero).join(sizes, key)
    minor, major = rows.where("cls <> major").withColumn("mine", _tile(F.col("minors"))), rows.where("cls = major").withColumn("mine", _tile(F.col("majors")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    among = minor.withColumn("other", every("minors")).select("*", F.least("mine", "other").alias("t"), F.greatest("mine", "other").alias("u"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    left = minor.withColumn("other", every("majors")).select("*", (-1 - F.col("other")).alias("t"), F.col("mine").alias("u"), F.lit(0).alias("side"))
    right = major.withColumn("other", every("minors")).select("*", (-1 - F.col("mine")).alias("t"), F.col("other").alias("u"), F.lit(1).alias("side"))
    more = _links(among.unionByName(left).unionByName(right), radius, similarity, exact)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge (a, b): node, root. Large-star and small-star rounds,
    each one written as a table, until nothing changes; only counts come to the driver. Rounds grow with the logarithm of
    the longest chain; beyond ``most_rounds`` it stops with an error rather than give wrong roots."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Each edge now goes from a larger to a smaller node; a node's smaller neighbours all move to the smallest.
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Classes of documents whose fingerprints are linked, directly or through others, by ``radius`` or fewer
    differing bits. Returns one row per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable, itself included).

    Null and blank texts have fingerprint 0 and link like any other. Rows of a null doc_id link like any other too, and get the class's smallest
    non-null id, or null where it has none. Repeated rows give repeated rows. Copies share a fingerprint and are compared once. An
    empty table gives an empty one. Extra columns, of whatever name, are not read.
    """
    rows = stored(fingerprints(whole_ids(docs)), "fingerprints")
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    nodes = prints.select("print", F.col("print").alias("node"), F.explode(band_keys(radius)).alias("k"), *[rest_keys().alias("rest")] * (radius == 2))
    finer = [F.col("rest")[F.col("k.band")].alias("finer")] * (radius == 2)
    roots = connected(nodes.select("k.*", "node", "print", F.lit(b"").alias("sketch"), *finer), radius)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "print")
    members = stored(prints.join(roots, "print").select("print", "least", "root"), "linked-fingerprints")
    least = stored(members.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    linked_ = members.join(least, "root").select("print", "component_id")
    alone = prints.join(members, "print", "left_anti").select("print", F.col("least").alias("component_id"))
    classes = stored(linked_.unionByName(alone), "classes")  # written, so that the join below has plain exchanges, whose hot partitions Spark splits
    return rows.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- classes of similar texts ----------------------------------------------------------------------
SHINGLE, SIMILARITY = 5, 0.8
#: Least hashes by which texts meet: two texts with the similarity miss each other with probability 0.2 ** MEETINGS.
MEETINGS, BINS = 10, 128
#: Probability with which SimHashes of two texts with the similarity may differ in more bits than are looked at.
MISSED = 1e-5
#: Similarity that sketches must show for texts to be compared at all: some six standard errors below SIMILARITY.
LOOSE = 0.6
#: Texts of a component of likely links that are compared in one group.
EXACT_TILE = 256


def bit_differs(shared: int, one: int, other: int) -> float:
    """Probability that a majority bit differs between two sets of random hashes that share so many and have so many alone."""
    half = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    total, alone = 0.0, (half(one), half(other))
    for k, p in enumerate(half(shared)):
        a, b = (sum(q for i, q in enumerate(c) if 2 * (k + i) > shared + len(c) - 1) for c in alone)
        total += p * (a * (1 - b) + b * (1 - a))
    return total


@lru_cache
def radius_for(similarity: float, missed: float = MISSED) -> int:
    """Differing bits that SimHashes of two sets of a Jaccard similarity or more exceed with at most the probability
    ``missed``. Small sets are the worst, as ties are common there; large ones tend to the angle between the sets."""
    sizes = [(s, a, d - a) for s in range(1, 33) for d in range(int(s / similarity - s + 1e-9) + 1) for a in range(d // 2 + 1)]
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, *(bit_differs(*x) for x in sizes))
    tail = lambda r: sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(r + 1, 65))
    return next(r for r in range(65) if tail(r) <= missed)


def shingles(part: np.ndarray, at: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles (A-Z in lower case) of texts laid end to end, and how many each text has. A text of
    fewer words is one shingle."""
    part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
    hashes, n, n_of_words = window_hashes(part, at, n_words)
    short = np.flatnonzero(n == 0)
    if len(short):
        words, _ = word_hashes(part, at)
        ends = np.cumsum(n_of_words)
        alone = np.array([mix(words[e - k : e] * _PLACES[:k]).sum(dtype=np.uint64) for k, e in zip(n_of_words[short], ends[short])], np.uint64)
        hashes, n = np.insert(hashes, np.cumsum(n)[short] - n[short], alone), np.maximum(n, 1)
    return hashes, n


def sketched(docs: DataFrame, n_words: int = SHINGLE, sets: bool = False) -> DataFrame:
    """node long, print long (SimHash of distinct word shingles, A-Z in lower case), least array<long> (minimum of the
    shingles under each of MEETINGS hashes) and sketch binary (a byte of the least shingle hash in each of BINS
    ranges, 0 for none). A text of fewer words is one shingle. ``docs``: node long, text string.
    With ``sets``, root (a long of ``docs``) and shingles binary (ascending distinct hashes) as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, MEETINGS + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, n = shingles(part, at, n_words)
                begins = np.cumsum(n) - n
                doc = np.repeat(np.arange(b - a), n)
                order = np.lexsort((hashes, doc))
                h, d = hashes[order], doc[order]
                bins = (h >> np.uint64(57)).astype(np.int64)
                first = np.concatenate([[True], (d[1:] != d[:-1]) | (bins[1:] != bins[:-1])])
                sketch = np.zeros((b - a, BINS), np.uint8)
                sketch[d[first], bins[first]] = h[first].astype(np.int64) % 255 + 1
                once = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])  # a set's shingles, not a text's
                ends = np.cumsum(np.bincount(d[once], minlength=b - a))
                of_text = np.split(h[once], ends[:-1])
                prints = pa.array(np.array([majority(x) for x in of_text], np.uint64).view(np.int64))
                bins_of_text = pa.array([x.tobytes() for x in sketch], pa.binary())
                least = np.column_stack([np.minimum.reduceat(mix(hashes ^ s), begins) for s in seeds])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * MEETINGS), pa.array(least.ravel().view(np.int64)))
                arrays, names = [batch.column(0)[a:b], prints, lists, bins_of_text], ["node", "print", "least", "sketch"]
                if sets:
                    arrays += [batch.column(2)[a:b], pa.array([x.tobytes() for x in of_text], pa.binary())]
                    names += ["root", "shingles"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    if sets:
        return docs.select("node", "text", "root").mapInArrow(run, "node long, print long, least array<bigint>, sketch binary, root long, shingles binary")
    return docs.select("node", "text").mapInArrow(run, "node long, print long, least array<bigint>, sketch binary")


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + AT_ONCE]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def sketch_similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard similarity of shingle sets as their sketches tell it."""
    used = (others | one) != 0
    return ((others == one) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of sets of ascending numbers."""
    if len(one) > len(other):
        one, other = other, one
    shared = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
    return shared / (len(one) + len(other) - shared)


def similar_classes(docs: DataFrame, n_words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Classes of texts linked, directly or through others, by a Jaccard similarity of word shingles of
    ``similarity`` or more: doc_id, component_id (smallest doc_id reachable). One row for each distinct doc_id.

    Texts meet in a group where any of their least hashes are equal; there, bit-sliced comparison of SimHash
    fingerprints (``radius_for``) and loosely compared sketches (LOOSE) leave likely links, which only say where to look:
    within each component of likely links, in tiles, texts that pass both filters are linked if the exact similarity of
    their distinct shingles, compared by 64-bit hashes, is high enough. So no link is made below ``similarity``. A link is
    missed if no least hash is equal (0.2 ** MEETINGS at the threshold; among the more than TILE texts of a hot least
    hash, if no second one is), by SimHash (MISSED) or by the sketch (about
    1e-7), unless other texts connect the two. Null texts count as empty; empty texts are similar to each other. Null ids have no
    row. Rows that repeat a doc_id are one node, linked by any of their texts. An empty table gives an empty one. Extra columns, of
    whatever name, are not read. A text of any length is sketched whole, some 100 bytes a word in a task.
    """
    rows = columns(whole_ids(docs), "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("text"))
    sketches = stored(sketched(rows, n_words), "sketches")
    keyed = sketches.select("node", "print", "sketch", "least", F.posexplode("least").alias("band", "x"))
    # Texts of a hot key meet where another of their least hashes is equal too.
    others = F.filter(F.transform("least", lambda v, i: F.when(i != F.col("band"), F.xxhash64(v, i))), lambda v: v.isNotNull())
    keyed = keyed.select("band", "x", F.lit(0).cast("long").alias("y"), "node", "print", "sketch", others.alias("finer"))
    radius = radius_for(similarity)
    likely = stored(connected(keyed, radius, LOOSE), "likely")
    likely = likely.unionByName(likely.select(F.col("root").alias("node"), "root")).distinct()
    sets = sketched(rows.join(likely, "node"), n_words, sets=True)
    # Of a component with many texts that aren't similar, only those meet that share a least hash, as similar ones do.
    every = F.transform("least", lambda v, i: F.xxhash64(v, i))
    grouped = sets.select(F.lit(0).alias("band"), F.col("root").alias("x"), F.lit(0).cast("long").alias("y"), "node", "print", "sketch", "shingles", every.alias("finer"))
    roots = connected(stored(grouped, "shingle-sets"), radius, LOOSE, EXACT_TILE, similarity)
    return sketches.select("node").distinct().join(roots, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("component_id"))


def drop_near(docs: DataFrame) -> DataFrame:
    """Stage form: one document of each class of similar texts stays, the one of the smallest doc_id, with all columns.
    Rows of a null doc_id stay; rows that repeat a doc_id stay or go together."""
    (gone_id,) = fresh(docs, "gone_id")
    gone = similar_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
