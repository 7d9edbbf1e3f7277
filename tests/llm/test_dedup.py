"""Exact, SimHash and substring deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from shotweave.llm import exact, packed, simhash, substring

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, " "), (None, "a b"), (6, "A b"), (6, "A b"), (7, LONG), (8, LONG + " end"), (9, "\u00a0x y"), (10, " x y")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'q' AS h", "1 AS n", "'en' AS lang", "CAST(NULL AS STRING) AS source", "2 AS keep_id") if extra else df


def sort(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_matches_brute_force(spark):
    got = exact.exact_groups(frame(spark, ODD), per_salt=2).collect()
    groups: dict[str, list] = {}
    for i, t in ODD:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in ODD:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sort(got) == sort(want)


def test_exact_tells_colliding_texts_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    md5 = F.md5
    monkeypatch.setattr(F, "md5", lambda c: md5(F.substring(c, 1, 1)))
    rows = [(1, "xa"), (2, "xb"), (3, "xb"), (4, "xa"), (5, "y")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(frame(spark, rows)).collect()}
    assert got == {1: (1, 2, True), 4: (1, 2, False), 2: (2, 2, True), 3: (2, 2, False), 5: (5, 1, True)}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact.exact_groups(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.similar_classes(none).count() == 0
    assert substring.without_repeats(none).count() == 0


def test_stage_keeps_columns_and_one_copy(spark):
    docs = frame(spark, ODD)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted([1, 3, 5, 6, 7, 8, 9, 10], key=str)


def test_stage_keeps_each_text_of_an_id(spark):
    rows = [(None, "n one"), (None, "n two"), (None, "n  two"), (None, "copy"), (1, "copy"), (2, "copy"), (2, "own"), (2, "other own"), (3, "own"), (None, None)]
    kept = exact.drop_copies(frame(spark, rows)).collect()
    assert sort((r.doc_id, norm(r.text)) for r in kept) == sort([(None, "n one"), (None, "n two"), (1, "copy"), (2, "own"), (2, "other own"), (None, "")])


def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    out = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return out


def test_simhash_matches_brute_force(spark):
    rows = [(i * 3 % 1000, t) for i, t in enumerate(near_texts())] + [(5001, None), (5002, ""), (5003, " \n"), (5004, LONG), (5005, "Élan ÉA"), (5006, "one two"), (5007, "one two")]
    prints = {i: simhash_of(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    assert len({find(i) for i in prints}) < len(prints)


def test_tiles_give_the_same_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3)
    prints = sorted({int(base[k % 3]) ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for k in range(200)})
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, print long")
    keyed = nodes.select("node", "print", F.explode(simhash.band_keys(2)).alias("k")).select("k.*", "node", "print", F.lit(b"").alias("sketch"))
    whole, tiled = ({r.node: r.root for r in simhash.connected(keyed, 2, tile=t).collect()} for t in (4096, 20))
    assert whole == tiled and whole


def test_hot_keys_are_made_finer_without_losing_links(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    # All share the first 32 bits; chains of fingerprints 2 bits apart in the others, at all places.
    prints = set()
    while len(prints) < 600:
        p = int(rng.integers(1 << 32)) << 32 | 12345
        for _ in range(4):
            prints.add(p - (p >> 63 << 64))
            p ^= 1 << int(rng.integers(32, 64)) | 1 << int(rng.integers(32, 64))
    nodes = spark.createDataFrame(list(enumerate(sorted(prints))), "node long, print long")
    keyed = nodes.select("node", "print", F.explode(simhash.band_keys(2)).alias("k"), simhash.rest_keys().alias("rest"))
    keyed = keyed.select("k.*", "node", "print", F.lit(b"").alias("sketch"), F.col("rest")[F.col("k.band")].alias("finer"))
    whole, finer = ({r.node: r.root for r in simhash.connected(k, 2, tile=t).collect()} for k, t in ((keyed.drop("finer"), 4096), (keyed, 20)))
    assert whole == finer and len(whole) > 300


def test_similar_texts_of_hot_least_hashes(spark, monkeypatch):
    rng, rows = random.Random(21), []
    for k in range(40):
        base = [f"r{rng.randrange(9000)}" for _ in range(120)]
        rows += [(4 * k + i, " ".join(base[: 120 - 3 * i] + [f"z{k}x{i}y{j}" for j in range(3 * i)])) for i in range(4)]
    rows += [(1000 + i, " ".join(["hot line of five words"] + [f"q{i}x{j}" for j in range(i % 5)])) for i in range(200)]
    want = jaccard_classes(rows)
    monkeypatch.setattr(simhash.connected, "__defaults__", (2, None, 4, None))
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(frame(spark, rows)).collect()} == want


def test_ids_that_are_no_integers(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for operator in (simhash.near_duplicates, simhash.similar_classes, substring.without_repeats):
        with pytest.raises(TypeError, match="integers"):
            operator(docs)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_chain(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (100, 100)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}


def test_similar_texts_share_a_class(spark):
    rng = random.Random(2)
    words = [f"u{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(600)]
    near = list(base)
    near[100] = near[300] = "changed"  # of 596 shingles 10 differ
    far = base[:300] + [rng.choice(words) for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, "few words"), (6, "few words"), (7, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 7: 4, 5: 5, 6: 5}
    assert sorted(r.doc_id for r in simhash.drop_near(frame(spark, rows)).collect()) == [1, 3, 4, 5]


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard_classes(rows, similarity=0.8):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_repeated_lines_leave_texts_similar(spark):
    rng, rows = random.Random(8), []
    for k in range(60):
        base = " ".join(f"r{rng.randrange(5000)}" for _ in range(504))
        line = " ".join(f"line{k}x{i}" for i in range(12))
        rows += [(2 * k, base), (2 * k + 1, f"{base} " + " ".join([line] * 20))]
    want = jaccard_classes(rows)
    assert len(set(want.values())) == 60
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(frame(spark, rows)).collect()} == want


def test_links_at_the_threshold_are_exact(spark):
    rng, rows = random.Random(11), []
    for k in range(120):
        n = rng.choice([20, 100, 600])
        base = [f"r{rng.randrange(9000)}" for _ in range(n + 4)]
        similarity = 0.75 + 0.1 * k / 120
        # Changing the last words leaves n - c of n + c shingles.
        c = round(n * (1 - similarity) / (1 + similarity))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n + 4 - c] + [f"z{k}x{i}" for i in range(c)]))]
    want = jaccard_classes(rows)
    assert 150 < len(set(want.values())) < 210
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(frame(spark, rows)).collect()} == want


def test_tiles_of_a_large_class_are_exact(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"r{rng.randrange(9000)}" for _ in range(104)]
    rows = []
    for k in range(90):
        c = rng.randint(0, 24)
        at = rng.randint(0, 104 - c)
        rows.append((k, " ".join(base[:at] + [f"z{k}x{i}" for i in range(c)] + base[at + c :])))
    want = jaccard_classes(rows)
    assert 1 < len(set(want.values())) < 90
    monkeypatch.setattr(simhash, "EXACT_TILE", 16)
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(frame(spark, rows)).collect()} == want


def test_radius_covers_sets_of_all_sizes():
    rng, radius = np.random.default_rng(1), simhash.radius_for(0.8)
    for s, a, b in [(4, 0, 1), (12, 1, 2), (80, 10, 10), (400, 0, 100)]:
        h = rng.integers(0, 1 << 64, (300, s + a + b), np.uint64)
        assert max((simhash.majority(x[: s + a]) ^ simhash.majority(np.delete(x, np.s_[s : s + a]))).bit_count() for x in h) <= radius
    assert simhash.radius_for(0.8, 0.1) < radius < 32


def removed(rows, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    late = 1 << 63
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, late), late if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (late if i is None else i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_matches_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = list(ODD)
    for i in range(20, 60):
        w = [f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 60))]
        at = rng.randrange(len(w) + 1)
        begin = rng.randrange(40)
        rows.append((i, "  ".join(w[:at] + passage[begin : begin + rng.randint(5, 30)] + w[at:])))
    rows += [(hash_id, "  ".join(passage[at : at + 20])) for at, hash_id in enumerate(rng.getrandbits(62) for _ in range(40))]  # scattered ids
    want = sort(removed(rows))
    assert any(r[2] for r in want)
    monkeypatch.setattr(packed, "PER_CELL", 0)
    for per_bucket, chunk in ((2_000_000, 4 << 20), (500, 200)):
        got = substring.digest(substring.without_repeats(frame(spark, rows), per_bucket=per_bucket, chunk=chunk)).collect()
        assert sort(got) == want


@pytest.mark.parametrize("size", [0, 10**6, 10**9, 5 * 10**10, 10**12])
def test_rows_grow_in_proportion(size):
    buckets, chunk = packed.layout(size)
    chunks = -(-size // chunk)
    assert buckets * chunks * packed.PER_CELL <= 2 * size / packed.WORD + packed.PER_CELL * (buckets + chunks + 1)


def test_input_in_another_order_each_time_is_stored(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"x{rng.randrange(90)}" for _ in range(20)] + passage[i % 5 : 20 + i % 9])) for i in range(300)]
    docs = frame(spark, rows).withColumn("by", F.rand()).orderBy("by").drop("by")
    got = substring.digest(substring.without_repeats(docs, per_bucket=500, chunk=2000)).collect()
    assert sort(got) == sort(removed(rows))


def test_fingerprints_of_null_ids_link_like_others(spark, monkeypatch):
    """Null rows get the class's id, and bridge two others that are farther apart than the radius."""
    prints = {"a": 0b0, "b": 0b11, "c": 0b1111, "far": 0xFFFF0000FFFF0000, "near far": 0xFFFF0000FFFF0001}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: spark.createDataFrame([(r.doc_id, prints[r.text]) if prints[r.text] < 1 << 63 else (r.doc_id, prints[r.text] - (1 << 64)) for r in docs.collect()], "doc_id long, print long"))
    rows = [(9, "a"), (None, "b"), (4, "c"), (None, "far"), (None, "near far")]
    got = sort((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == sort([(9, prints["a"], 4), (None, prints["b"], 4), (4, prints["c"], 4), (None, prints["far"], None), (None, prints["near far"], None)])


def test_stage_forms_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    from shotweave.llm import decontam, mixing, quality

    text = "some words that tell of a thing at length and then of another one besides"
    clash = {c: F.lit("mine") for c in ("gone_id", "bad_row", "bad row", "own sha", "SHA", "kept_id", "kept sha", "kept_sha", "good_id", "good id", "row", "gone_id_")}
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, text + " so", "s"), (4, "benchmark item with quite a few words in it to be found here whole", "s"), (None, "x", None)], "doc_id long, text string, source string").withColumns(clash)
    bench = spark.createDataFrame([(7, "benchmark item with quite a few words in it to be found here whole", "v")], "item_id long, text string, row string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    forms = [(lambda d: exact.drop_copies(d), {1, 3, 4, None}), (simhash.drop_near, {1, 4, None}), (lambda d: decontam.drop_contaminated(d, bench), {1, 2, 3, None}), (lambda d: quality.drop_rejected(d, labels), None)]
    for form, ids in forms:
        kept = form(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert ids is None or {r.doc_id for r in rows} == ids
        assert all(r["gone_id"] == r["own sha"] == r["SHA"] == "mine" for r in rows)
    assert mixing.mixed(docs).count() >= 5


def test_loose_chains_cost_what_they_have(spark, monkeypatch):
    """Texts of one component, none of them similar enough to another: what meets grows with their number, not its square."""
    shipped = {}
    links = simhash._links

    def counted(rows, radius, similarity, exact):
        if exact is not None:
            shipped[size] = shipped.get(size, 0) + rows.count()
        return links(rows, radius, similarity, exact)

    monkeypatch.setattr(simhash, "_links", counted)
    rng = np.random.default_rng(0)
    for size in (600, 1200, 2400):
        sets = [np.sort(rng.integers(0, 1 << 62, 40)).astype(np.uint64) for _ in range(size)]
        rows = [(0, 5, 0, k, 0, bytes(simhash.BINS), s.tobytes(), [int(x) for x in s[:10]]) for k, s in enumerate(sets)]
        keyed = spark.createDataFrame(rows, "band int, x long, y long, node long, print long, sketch binary, shingles binary, finer array<long>")
        assert simhash.connected(keyed, 64, 0.0, 256, 0.8).count() == 0
    assert shipped[2400] < 2.2 * shipped[1200] < 4.84 * shipped[600]


def test_short_texts_fill_chunks():
    import pyarrow as pa

    def batches(n):
        for at in range(0, n, 1000):
            ids = np.arange(at, min(n, at + 1000))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(["x" * 499 + "y"] * len(ids))], ["doc_id", "key", "text"])

    made = list(packed.named_chunks(batches(20_500), 1_600_000))
    assert [len(c[2]) for c in made[:-1]] == [1_600_000] * 6
    assert np.concatenate([c[1] for c in made]).tolist() == list(range(20_500))
    assert [c[0] for c in made] == [c[0] for c in packed.named_chunks(batches(20_500), 1_600_000)]


def test_words_are_hashed_in_slices(monkeypatch):
    from shotweave.llm import common

    rng = random.Random(7)
    texts = ["", "one", " ", *["".join(rng.choice("ab é\t\n") for _ in range(rng.randrange(400))) for _ in range(60)], "x" * 300, ""]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    whole = common.word_hashes(data, offsets)
    for size in (7, 64, 1000):
        monkeypatch.setattr(common, "SLICE", size)
        got = common.word_hashes(data, offsets)
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()
    assert whole[1].tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_a_hundred_megabytes_are_hashed_in_bounded_memory():
    import tracemalloc

    from shotweave.llm import common

    data = np.frombuffer(b"some words of a very long text 0123456789 " * 2_400_000, np.uint8)
    assert len(data) > 100_000_000
    tracemalloc.start()
    hashes, n = common.word_hashes(data, np.array([0, len(data)]))
    assert len(hashes) == n[0] == 8 * 2_400_000
    assert tracemalloc.get_traced_memory()[1] < 8 * len(hashes) * 2 + 100_000_000
    tracemalloc.stop()


def test_a_consistent_item_is_found_behind_an_inconsistent_one(spark):
    from shotweave.llm import decontam

    item = "A trader had 5 boxes and gave 5 boxes to a friend who had 5 boxes and then lost 5 boxes on the way home to the old town by the river"
    said = lambda values, more="": item.replace("5", "%s").replace("a friend", f"a {more}friend") % tuple(values)
    rows = [
        (1, said("9999", "good ")),
        (2, said("6894") + ". Later on. " + said("9999", "good ")),
        (3, said("6894") + " " + said("9999", "very good old ")),
        (4, said("6894")),
        (5, said("6894") + ". " + said("8964", "good ")),
        (6, said("9999", "good ") + ". " + said("6894")),
        (7, "nothing of the kind in here at all, and 5 boxes of it"),
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.n_changed for r in decontam.contaminated(frame(spark, rows), bench).where("n_matched > 0").collect()}
    assert set(got) == {1, 2, 3, 6} and min(got.values()) > 0
