"""Labels, roles, corrections: rules over lists of boundaries and replay of an operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The window that a split snaps in, and how near another boundary may be, in seconds.
SNAP_BEFORE, SNAP_AFTER, TOO_NEAR = 2.0, 0.5, 0.25


def label_error(b: Column, duration: Column, most: int | None = None) -> Column:
    """Why a list of boundaries isn't valid, or null: empty, not increasing, not positive, past the end, too many."""
    rises = F.forall(F.sequence(F.lit(2), F.greatest(F.size(b), F.lit(2))), lambda i: F.coalesce(F.try_element_at(b, i) > F.try_element_at(b, i - 1), F.lit(True)))
    error = F.when(b.isNull() | (F.size(b) == 0), "empty").when(~rises, "not increasing").when(F.array_min(b) <= 0, "not positive").when(F.array_max(b) >= duration, "past the end")
    return error.when(F.size(b) > most, "too many") if most else error


def merged(b: Column, scene: Column) -> Column:
    """The list without the boundary after scene ``scene`` (from 0); unchanged if there's none."""
    return F.filter(b, lambda x, i: (i != scene) | (scene < 0))


def inserted(b: Column, at: Column, duration: Column) -> Column:
    """The list with one more boundary, in order; unchanged if it isn't inside or one is already there."""
    fits = (at > 0) & (at < duration) & F.forall(b, lambda x: F.abs(x - at) >= TOO_NEAR)
    return F.when(fits, F.array_sort(F.concat(b, F.array(at)))).otherwise(b)


def snapped(at: Column, cuts: Column) -> Column:
    """The cut nearest to a moment within the window that a split snaps in (the earlier on ties), else the moment; to 3 places."""
    near = F.filter(cuts, lambda c: (c >= at - SNAP_BEFORE) & (c <= at + SNAP_AFTER))
    best = F.array_min(F.transform(near, lambda c: F.struct(F.abs(c - at).alias("off"), c.alias("cut"))))["cut"]
    return F.bround(F.coalesce(best, at), 3)


def replayed(log: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Final boundaries and the hard examples of each video. ``log``: video, seq, op, scene_index, at, predicted
    array<double>, duration. ``cuts``: video, time, where splits snap to. Returns video, boundaries, hard_negatives,
    hard_positives, refused (how many operations were).

    merge takes out the boundary after a scene, and is refused where there is none; split adds one, snapped to the nearest
    cut, and is refused outside the video or beside another boundary; clear takes out all; reset goes back to what was
    predicted and forgets the examples; confirm and others change nothing. Each operation acts on what the ones before
    left, so it is a fold over one video's log."""
    entry = F.struct("seq", "op", "scene_index", "at")
    rows = log.groupBy("video").agg(F.array_sort(F.collect_list(entry)).alias("ops"), F.first("predicted").alias("predicted"), F.max("duration").alias("duration"))
    none = F.array().cast("array<double>")
    if cuts is None:
        rows = rows.withColumn("cuts", none)
    else:
        rows = rows.join(cuts.groupBy("video").agg(F.array_sort(F.collect_list(F.col("time").cast("double"))).alias("cuts")), "video", "left")
    start = F.struct(F.array_sort("predicted").alias("b"), none.alias("neg"), none.alias("pos"), F.lit(0).alias("refused"))

    def step(s: Column, o: Column) -> Column:
        op, b = o["op"], s["b"]
        merges = (op == "merge") & (o["scene_index"] >= 0) & (o["scene_index"] < F.size(b))
        at = snapped(o["at"], F.coalesce("cuts", none))
        longer = inserted(b, at, F.col("duration"))
        splits = (op == "split") & (F.size(longer) > F.size(b))
        gone = F.element_at(b, (F.when(merges, o["scene_index"]).otherwise(F.lit(0)) + 1).cast("int"))
        resets = op == "reset"
        after = F.when(op == "clear", none).when(resets, F.array_sort("predicted")).when(merges, merged(b, o["scene_index"])).when(splits, longer).otherwise(b)
        neg = F.when(resets, none).when(merges, F.concat(s["neg"], F.array(gone))).otherwise(s["neg"])
        pos = F.when(resets, none).when(splits, F.concat(s["pos"], F.array(at))).otherwise(s["pos"])
        refused = s["refused"] + (op.isin("merge", "split") & ~merges & ~splits).cast("int")
        return F.struct(after.alias("b"), neg.alias("neg"), pos.alias("pos"), refused.alias("refused"))

    rows = rows.withColumn("end", F.aggregate("ops", start, step))
    told = [F.col(f"end.{c}").alias(name) for c, name in (("b", "boundaries"), ("neg", "hard_negatives"), ("pos", "hard_positives"), ("refused", "refused"))]
    return rows.select("video", *told)


def overlapping_roles(roles: DataFrame) -> DataFrame:
    """Names in more than one role: stem, n_roles."""
    return roles.groupBy("stem").agg(F.countDistinct("role").alias("n_roles")).where("n_roles > 1")


def refuse_leaks(train: DataFrame, held_out: DataFrame) -> None:
    """Raise if a name is in both."""
    if train.select("stem").intersect(held_out.select("stem")).limit(1).count():
        raise ValueError("held-out names are in the training set")


def deterministic_split(names: DataFrame, seed: int, test_share: float = 0.3) -> DataFrame:
    """A role for each name by its hash: the test share of names, at least one of two: stem, role.

    The names of the least hashes are the test set. Hashes are counted in 1,024 ranges; only the range in which the share
    ends is ordered, so no task holds all names."""
    from pyspark.sql import Window

    h = F.xxhash64(F.lit(seed), "stem")
    rows = names.select("stem").distinct().select("stem", h.alias("h"), F.shiftright(h, 54).alias("range"))
    ranges = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    up, all_ = Window.orderBy("range"), Window.partitionBy()  # over at most 1,024 rows
    n = F.sum("n").over(all_)
    most = F.greatest(F.round(n * test_share), (n >= 2).cast("int")).cast("long")
    ranges = ranges.select("range", (F.sum("n").over(up) - F.col("n")).alias("before"), F.col("n"), most.alias("most"))
    rows = rows.join(F.broadcast(ranges), "range")
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "stem")) + F.col("before")
    cut = rows.where((F.col("before") < F.col("most")) & (F.col("before") + F.col("n") > F.col("most")))
    cut = cut.select("stem", F.when(place <= F.col("most"), "test").otherwise("dev").alias("role"))
    whole = rows.where((F.col("before") >= F.col("most")) | (F.col("before") + F.col("n") <= F.col("most")))
    return whole.select("stem", F.when(F.col("before") < F.col("most"), "test").otherwise("dev").alias("role")).unionByName(cut)
