"""Looking at errors and at similarity measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from . import fit


def error_rows(errors: DataFrame, cuts: DataFrame, reach: int) -> DataFrame:
    """video, at, diagnosis, place: whether a cut lies at or within ``reach`` frames of each error."""
    near = cuts.select(F.col("video"), F.explode(F.sequence(F.col("cut") - reach, F.col("cut") + reach)).alias("at"), "cut")
    best = near.groupBy("video", "at").agg(F.min(F.abs(F.col("cut") - F.col("at"))).alias("off"))
    kind = F.when(F.col("off").isNull(), "no cut").when(F.col("off") == 0, "on the cut").otherwise("near a cut")
    w = Window.partitionBy("video").orderBy("at")
    return errors.join(best, ["video", "at"], "left").select("video", "at", kind.alias("diagnosis"), F.row_number().over(w).cast("long").alias("place"))


#: Ranges of scores that are summed up apart, so that few keys (of ``by``) still make many tasks.
RANGES = 256


def running(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Each distinct score with what lies below it: by, _score, c (rows of it), p (positives among them), c_before, p_before,
    c_all, p_all, and next (the score above it). Scores are dealt in ranges by approximate quantiles; ranges are summed up
    first, and within each only its own scores are ordered. Null scores are left out."""
    rows = rows.where(F.col(score).isNotNull()).select(*by, F.col(score).alias("_score"), F.col(positive).alias("_positive"))
    return _sums(materialised(rows.groupBy(*by, "_score").agg(F.count(F.lit(1)).alias("c"), F.count_if("_positive").alias("p")), "scores"), by)


def _marks(values: DataFrame, by: list[str]) -> DataFrame:
    """The scores at which ranges begin: by, marks."""
    return values.groupBy(*by).agg(F.percentile_approx("_score", [i / RANGES for i in range(1, RANGES)], 1000).alias("marks"))


def _ranged(values: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """Adds range: how many marks are at most the score. Every sixteenth mark is looked at first, then those between two of them."""
    one = F.lit(1)
    values = values.join(F.broadcast(marks), by) if by else values.withColumn("_one", one).join(F.broadcast(marks.withColumn("_one", one)), "_one").drop("_one")
    passed = lambda some: F.size(F.filter(some, lambda m: m <= F.col("_score")))
    step = 16
    values = values.withColumn("_coarse", passed(F.expr(f"transform(sequence({step}, {RANGES - 1}, {step}), i -> marks[i - 1])")) * step)
    return values.withColumn("range", F.col("_coarse") + passed(F.slice("marks", F.col("_coarse") + 1, step))).drop("marks", "_coarse")


def _placed(values: DataFrame, by: list[str], number: str = "k") -> DataFrame:
    """Of counts (by, _score, c, p, range; each score once) what :func:`running` gives, with range and ``number``, that of the score from 0."""
    score = "_score"
    ranges = values.groupBy(*by, "range").agg(F.sum("c").alias("rc"), F.sum("p").alias("rp"), F.count(F.lit(1)).alias("rk"), F.min(score).alias("least"))
    up, all_ = Window.partitionBy(*by).orderBy("range"), Window.partitionBy(*by)
    below = [(F.sum(f"r{x}").over(up) - F.col(f"r{x}")).alias(f"{x}_below") for x in ("c", "p", "k")]
    ranges = ranges.select(*by, "range", *below, F.sum("rc").over(all_).alias("c_all"), F.sum("rp").over(all_).alias("p_all"), F.lead("least").over(up).alias("after"))
    own = Window.partitionBy(*by, "range").orderBy(score)
    before = lambda x: F.sum(x).over(own) - F.col(x) + F.col(f"{x}_below")
    rows = values.join(F.broadcast(ranges), [*by, "range"])
    told = [before("c").alias("c_before"), before("p").alias("p_before"), "c_all", "p_all", F.coalesce(F.lead(score).over(own), "after").alias("next")]
    return rows.select(*by, score, "c", "p", *told, "range", (F.row_number().over(own) - 1 + F.col("k_below")).alias(number))


def _sums(values: DataFrame, by: list[str]) -> DataFrame:
    """What :func:`running` gives, of counts: by, _score, c, p, each score once."""
    return _placed(_ranged(values, _marks(values, by), by), by, "_k").drop("range", "_k")  # groups may be by a k


def _auc(sums: DataFrame, by: list[str]) -> DataFrame:
    p, n = F.max("p_all"), F.max("c_all")
    total = F.sum(F.col("p") * (F.col("c_before") + (F.col("c") + 1) / 2))
    return sums.groupBy(*by).agg(n.alias("n"), ((total - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0))).alias("auc"))


def _precision(sums: DataFrame, by: list[str]) -> DataFrame:
    precision = (F.col("p_all") - F.col("p_before")) / (F.col("c_all") - F.col("c_before"))
    return sums.groupBy(*by).agg((F.sum(F.col("p") * precision) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))


def _threshold(sums: DataFrame, by: list[str]) -> DataFrame:
    """A group of one score only has that as its threshold."""
    above = F.col("next").isNotNull().cast("int")
    tp, said = F.col("p_all") - F.col("p_before") - F.col("p") * above, F.col("c_all") - F.col("c_before") - F.col("c") * above
    rows = sums.where("next IS NOT NULL OR c = c_all")
    rows = rows.select(*by, F.coalesce((F.col("_score") + F.col("next")) / 2, "_score").alias("threshold"), (2 * tp / F.nullif(said + F.col("p_all"), F.lit(0))).alias("f1"))
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")
    return rows.groupBy(*by).agg(best).select(*by, F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def rank_auc(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve from average ranks: by, n, auc (null without both classes)."""
    return _auc(running(rows, score, positive, by), by)


def best_threshold(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """The midpoint between neighbouring scores whose F1 is best, the lowest on ties: by, threshold, f1."""
    return _threshold(running(rows, score, positive, by), by)


def _hulls(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The upper hulls of all stretches of 1, 2, 4, ... points (x ascends): for each length the places of the hulls' points, one hull after
    the other, and where each begins. A hull is made of the points of its two halves' hulls."""
    n = len(x)
    levels = [(np.arange(n), np.arange(n + 1))]
    xs, ys = x.tolist(), y.tolist()
    while len(levels[-1][1]) > 2:
        points, starts = levels[-1][0].tolist(), levels[-1][1].tolist()
        out: list[int] = []
        begins = [0]
        for a in range(0, len(starts) - 1, 2):
            first = len(out)
            for i in points[starts[a] : starts[min(a + 2, len(starts) - 1)]]:
                while len(out) - first > 1 and (xs[out[-1]] - xs[out[-2]]) * (ys[i] - ys[out[-2]]) >= (ys[out[-1]] - ys[out[-2]]) * (xs[i] - xs[out[-2]]):
                    out.pop()
                out.append(i)
            begins.append(len(out))
        levels.append((np.array(out), np.array(begins)))
    return levels


def steepest(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """For each question the point of the stretch ``lo`` to ``hi`` (without it, not empty) to which the line from (``x0``, ``y0``) is steepest, of equally steep ones the
    last. x ascends and is over ``x0`` there. A stretch is put together from a few whole ones of :func:`_hulls`; along
    a hull lines get steeper up to the best point, so it is found by halving."""
    best, slope = np.full(len(lo), -1), np.full(len(lo), -np.inf)

    def look(points: np.ndarray, starts: np.ndarray, on: np.ndarray, node: np.ndarray) -> None:
        a, b = starts[node], starts[node + 1] - 1
        while (open_ := a < b).any():
            middle = (a + b) // 2
            i, j = points[middle], points[np.minimum(middle + 1, len(points) - 1)]
            further = (y[j] - y0[on]) * (x[i] - x0[on]) >= (y[i] - y0[on]) * (x[j] - x0[on])
            a, b = np.where(open_ & further, middle + 1, a), np.where(open_ & ~further, middle, b)
        found = points[a]
        s = (y[found] - y0[on]) / (x[found] - x0[on])
        better = (s > slope[on]) | ((s == slope[on]) & (found > best[on]))
        best[on[better]], slope[on[better]] = found[better], s[better]

    lo, hi = lo.copy(), hi.copy()
    for points, starts in _hulls(x, y):
        odd = np.flatnonzero((lo < hi) & (lo & 1 == 1))
        look(points, starts, odd, lo[odd])
        lo[odd] += 1
        odd = np.flatnonzero((lo < hi) & (hi & 1 == 1))
        hi[odd] -= 1
        look(points, starts, odd, hi[odd])
        lo, hi = lo >> 1, hi >> 1
    return best


def _best_in_range(values: pa.Table, groups: pa.Table, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one range of scores the best cut for each group over all other groups: places in ``groups``, k, F1 (doubled true ones over said and true). ``strict``: what lies over
    a score is said, and others lie at or below it too; else what lies at or over it. ``values``: k, c, p, c_before, p_before, c_all, p_all. ``groups``: all_c, all_p (of the group),
    above_c, above_p (of it over the range), held (its own k, c, p in the range)."""
    values = values.sort_by([("k", "descending")])
    k, c, p, c_before, p_before = (values.column(x).to_numpy() for x in ("k", "c", "p", "c_before", "p_before"))
    c_all, p_all = values.column("c_all")[0].as_py(), values.column("p_all")[0].as_py()
    said, tp = c_all - c_before - c * strict, p_all - p_before - p * strict  # ascend, from the highest score on
    m, n = groups.num_rows, len(k)
    lists = groups.column("held").combine_chunks()
    held = lists.flatten()
    of = np.append(np.repeat(np.arange(m), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), np.arange(m))
    # A group's counts are the same between two of its own scores: stretches of cuts, each up to one of them, and the last up to the end of the range.
    at = k[0] - np.asarray(held.field("k"))
    own_c, own_p = (np.append(np.asarray(held.field(x)), np.zeros(m, np.int64)) for x in ("c", "p"))
    edge = np.append(at + strict, np.full(m, n))
    order = np.lexsort((edge, of))
    of, edge, own_c, own_p = of[order], edge[order], own_c[order], own_p[order]
    first = np.append(True, of[1:] != of[:-1])
    lo = np.where(first, 0, np.append(0, edge[:-1]))
    base = lambda x: (np.cumsum(x) - x) - (np.cumsum(x) - x)[first][of]
    all_c, all_p, above_c, above_p = (groups.column(x).to_numpy()[of] for x in ("all_c", "all_p", "above_c", "above_p"))
    b, a, positive = above_c + base(own_c), above_p + base(own_p), p_all - all_p
    lo = np.maximum(lo, np.searchsorted(said, b, "right"))
    hi = np.minimum(edge, np.searchsorted(said, c_all - all_c + b, "left")) if strict else edge
    on = np.flatnonzero(lo < hi)
    of, a, b, positive = of[on], a[on], b[on], positive[on]
    best = steepest(said, tp, lo[on], hi[on], b - positive, a)
    f1 = 2 * (tp[best] - a) / (said[best] - b + positive)
    order = np.lexsort((k[best], -f1, of))
    order = order[np.append(True, of[order][1:] != of[order][:-1])[: len(order)]]
    return of[order], k[best][order], f1[order]


def _best_of_the_others(rows: DataFrame, score: str, positive: str, group: str, by: list[str], strict: bool) -> DataFrame:
    """For each group the best cut over the rows of all other groups (of the same ``by``), the lowest on ties: by, group, low, high. ``strict``: it lies between the scores low and high
    of others (low alone, high null, where they have one score only); else it is the score low.

    Work grows with the rows, not with groups times scores: scores are dealt in ranges, and in each a group's counts are those of all rows less its own, so
    between two of its own scores its best cut is a tangent to a hull that all groups share (:func:`steepest`). Counts are whole numbers; cuts tie where F1 is the same double."""
    rows = rows.where(F.col(score).isNotNull()).select(*by, group, F.col(score).alias("_score"), F.col(positive).alias("_positive"))
    own = materialised(rows.groupBy(*by, group, "_score").agg(F.count(F.lit(1)).alias("c"), F.count_if("_positive").alias("p")), "scores")
    sole = F.when(F.count(F.lit(1)) == 1, F.min(group)).alias("sole")
    total = materialised(own.groupBy(*by, "_score").agg(F.sum("c").alias("c"), F.sum("p").alias("p"), sole), "all-scores")
    marks = materialised(_marks(total, by), "marks")
    placed = materialised(_placed(_ranged(total.drop("sole"), marks, by), by).join(total.select(*by, "_score", "sole"), [*by, "_score"]), "placed-scores")
    own = materialised(own.join(placed.select(*by, "_score", "k", "range", "sole"), [*by, "_score"]), "own-scores")
    groups = own.groupBy(*by, group).agg(F.sum("c").alias("all_c"), F.sum("p").alias("all_p"))
    inside = own.groupBy(*by, group, "range").agg(F.collect_list(F.struct("k", "c", "p")).alias("held"), F.sum("c").alias("own_c"), F.sum("p").alias("own_p"))
    every = groups.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1)))).join(inside, [*by, group, "range"], "left").na.fill(0, ["own_c", "own_p"])
    over = Window.partitionBy(*by, group).orderBy(F.desc("range"))
    above = [(F.sum(f"own_{x}").over(over) - F.col(f"own_{x}")).alias(f"above_{x}") for x in ("c", "p")]
    every = every.select(*by, "range", group, "all_c", "all_p", *above, "held")
    schema = own.select(*by, group).schema

    def work(values: pa.Table, groups: pa.Table) -> pa.Table:
        some, k, f1 = _best_in_range(values, groups, strict) if values.num_rows and groups.num_rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([*(groups.column(c).take(pa.array(some)) for c in schema.names), pa.array(k, pa.int64()), pa.array(f1, pa.float64())], [*schema.names, "k", "f1"])

    keys = [*by, "range"]
    values = placed.select(*keys, "k", "c", "p", "c_before", "p_before", "c_all", "p_all").groupBy(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    cuts = values.cogroup(every.groupBy(*keys)).applyInArrow(work, f"{kinds}, k long, f1 double")
    cuts = cuts.groupBy(*by, group).agg(F.max_by("k", F.struct("f1", -F.col("k"))).alias("k"))
    cuts = groups.select(*by, group).join(cuts, [*by, group], "left")
    # Scores that only the group itself has are none of the others': runs of them are passed over.
    run = F.col("k") - F.row_number().over(Window.partitionBy(*by, group).orderBy("k"))
    runs = own.where(F.col("sole") == F.col(group)).select(*by, group, "k", run.alias("run")).groupBy(*by, group, "run").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    at, after = F.coalesce("k", F.lit(0).cast("long")), F.col("k") + 1
    holds = lambda x: (F.col("first") <= x) & (x <= F.col("last"))
    past = lambda x, to: F.coalesce(F.max(F.when(holds(x), to)), F.max(x))
    down = F.when(F.max("k").isNotNull(), past(at, F.col("first") - 1)).otherwise(past(at, F.col("last") + 1)) if strict else past(at, F.col("last") + 1)
    ends = cuts.join(runs, [*by, group], "left").groupBy(*by, group).agg(down.alias("low_k"), past(after, F.col("last") + 1).alias("high_k"))
    low, high = (placed.select(*by, F.col("k").alias(f"{end}_k"), F.col("_score").alias(end)) for end in ("low", "high"))
    return ends.join(low, [*by, "low_k"]).join(high, [*by, "high_k"], "left").select(*by, group, "low", "high")


def left_out_threshold(rows: DataFrame, score: str, positive: str, group: str, by: tuple[str, ...] = ()) -> DataFrame:
    """For each group the score from which on F1 is best over all other groups, the lowest on ties: by, group, cut."""
    return _best_of_the_others(rows, score, positive, group, list(by), False).select(*by, group, F.col("low").alias("cut"))


def held_out(rows: DataFrame, score: str, positive: str, group: str, by: tuple[str, ...] = ()) -> DataFrame:
    """F1 of each group judged by the threshold (a midpoint between scores) that is best over all others, counts pooled over groups: by, held_out_f1."""
    best = _best_of_the_others(rows, score, positive, group, list(by), True)
    best = best.select(*by, group, F.coalesce((F.col("low") + F.col("high")) / 2, "low").alias("threshold"))
    return rows.join(best, [*by, group]).groupBy(*by).agg(F.coalesce(pooled_f1(F.col(score) >= F.col("threshold"), F.col(positive)), F.lit(0.0)).alias("held_out_f1"))


def pooled_f1(said: Column, positive: Column) -> Column:
    """F1 of counts pooled over all rows."""
    tp, fp, fn = F.count_if(said & positive), F.count_if(said & ~positive), F.count_if(~said & positive)
    return 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))


#: Parts of a stratum that are ordered apart before the first of each are.
SALTS = 64


def round_robin(rows: DataFrame, stratum: str, group: str, order: list, most: int) -> DataFrame:
    """At most ``most`` rows of each stratum, taken in turn from its groups: adds turn and place. What is beyond ``most`` in
    its group or in its part of the stratum goes first, so the last order is of few rows."""
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum, group).orderBy(*order))).where(F.col("turn") <= most)
    salt = F.pmod(F.xxhash64(group), F.lit(SALTS))
    firsts = turns.withColumn("_salt", salt).withColumn("_place", F.row_number().over(Window.partitionBy(stratum, "_salt").orderBy("turn", group)))
    firsts = firsts.where(F.col("_place") <= most).drop("_salt", "_place")
    places = firsts.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("turn", group)))
    return places.where(F.col("place") <= most)


def average_precision(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """The mean over positives of the precision at their score; equal scores count together: by, ap."""
    return _precision(running(rows, score, positive, by), by)


def combined(pairs: DataFrame, combinations: dict[str, list[str]], positive: str, group: str, keys: list[str], c: float = 1.0) -> DataFrame:
    """Adds a column for each combination of measures: the probability by a logistic model of them that didn't see the pair's
    group. Models of all groups are fitted together (see :mod:`.fit`). ``keys`` name a pair; null measures aren't allowed."""
    rows = materialised(fit.folded(pairs.withColumn("video", F.col(group))), "pairs")
    models = fit.left_out((rows.agg(F.max("fold")).first()[0] or 0) + 1)
    for name, measures in combinations.items():
        ready = fit.prepared(rows.withColumn("label", F.col(positive).cast("int")), measures, keys)
        p = fit.scored(ready, fit.logistic(ready, [c], models, balanced=False, standardised=False), keys).select(*keys, F.col("p").alias(name))
        pairs = pairs.join(materialised(p, "combined"), keys)
    return pairs


def measure_study(pairs: DataFrame, measures: list[str], positive: str, group: str | None = None) -> DataFrame:
    """How well each measure tells pairs apart: measure, n, auc, ap, threshold, f1 and, with a ``group``, held_out_f1 (:func:`held_out`)."""
    value = [F.struct(F.lit(m).alias("measure"), F.round(F.col(f"`{m}`"), 9).alias("value")) for m in measures]
    rows = pairs.select(positive, *[group] * (group is not None), F.inline(F.array(*value)))
    sums = materialised(running(rows, "value", positive, ["measure"]), "running")
    out = _auc(sums, ["measure"]).join(_precision(sums, ["measure"]), "measure").join(_threshold(sums, ["measure"]), "measure")
    return out if group is None else out.join(held_out(materialised(rows, "values"), "value", positive, group, ("measure",)), "measure")


def labelled_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with a clear label, as ``duplicate``: D is one, N isn't, others (unsure) are left out. Joined by ``pair``."""
    return pairs.join(labels.where(F.col("label").isin("D", "N")), "pair").withColumn("duplicate", F.col("label") == "D").drop("label")
