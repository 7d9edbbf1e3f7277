"""A log of corrections as a stream: the state of each video is what its operations have left so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.labels import SNAP_AFTER, SNAP_BEFORE, TOO_NEAR

OPERATION = "seq long, op string, scene_index int, at double"
STATE = "boundaries array<double>, negatives array<double>, positives array<double>, refused int, n long"
START = "predicted array<double>, duration double, cuts array<double>"


def applied(state: tuple, o: tuple, start: tuple) -> tuple:
    """The state after one operation (see :func:`shotweave.operators.labels.replayed`)."""
    (b, neg, pos, refused, n), (_, op, scene, at), (predicted, duration, cuts) = state, o, start
    b, n = list(b), n + 1
    if op == "clear":
        return [], neg, pos, refused, n
    if op == "reset":
        return sorted(predicted), [], [], refused, n
    if op == "merge":
        if scene is None or not 0 <= scene < len(b):
            return b, neg, pos, refused + 1, n
        return b[:scene] + b[scene + 1 :], [*neg, b[scene]], pos, refused, n
    if op == "split":
        near = [c for c in cuts if at - SNAP_BEFORE <= c <= at + SNAP_AFTER]
        to = round(min(near, key=lambda c: (abs(c - at), c)) if near else at, 3)
        if not 0 < to < duration or any(abs(x - to) < TOO_NEAR for x in b):
            return b, neg, pos, refused + 1, n
        return sorted([*b, to]), neg, [*pos, to], refused, n
    return b, neg, pos, refused, n


class LogState(StatefulProcessor):
    """Per video: its operations, and what they have left. Operations that come in order are folded on to that; where one comes late, the log is
    replayed with it in its place, so the state is that of the whole log whatever the order of its parts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.start, self.log = handle.getValueState("state", STATE), handle.getValueState("start", START), handle.getListState("log", OPERATION)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            if not self.start.exists():
                first = batch.iloc[0]
                self.start.update((list(first["predicted"]), float(first["duration"]), [] if first["cuts"] is None else list(first["cuts"])))
            for seq, op, scene, at in batch[["seq", "op", "scene_index", "at"]].itertuples(index=False, name=None):
                new.append((int(seq), op, None if pd.isna(scene) else int(scene), None if pd.isna(at) else float(at)))
        start = self.start.get()
        order = lambda o: tuple((x is not None, x) for x in o)
        known = list(self.log.get()) if self.state.exists() else []
        state = self.state.get() if known else (sorted(start[0]), [], [], 0, 0)
        if known and min(map(order, new)) < max(order(tuple(o)) for o in known):
            new, state = [tuple(o) for o in known] + new, (sorted(start[0]), [], [], 0, 0)
            self.log.clear()
        new.sort(key=order)
        for o in new:
            state = applied(state, o, start)
        self.log.appendList(new)
        self.state.update(tuple(state))
        b, neg, pos, refused, n = state
        yield pd.DataFrame({"video": [key[0]], "n": [n], "boundaries": [list(b)], "hard_negatives": [list(neg)], "hard_positives": [list(pos)], "refused": [refused]})

    def close(self) -> None:
        pass


def streamed_replay(log: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """What each video's operations have left, after every batch that has some: video, n (operations so far), boundaries, hard_negatives,
    hard_positives, refused. ``log`` and ``cuts`` as for :func:`shotweave.operators.labels.replayed`; the cuts are no stream. Needs the RocksDB state store."""
    if cuts is None:
        rows = log.withColumn("cuts", F.array().cast("array<double>"))
    else:
        near = cuts.groupBy("video").agg(F.array_sort(F.collect_list(F.col("time").cast("double"))).alias("cuts"))
        rows = log.join(near, "video", "left")
    kind = log.schema["video"].dataType.simpleString()
    told = f"video {kind}, n long, boundaries array<double>, hard_negatives array<double>, hard_positives array<double>, refused int"
    rows = rows.select("video", F.col("seq").cast("long").alias("seq"), "op", "scene_index", "at", "predicted", "duration", "cuts")
    return rows.groupBy("video").transformWithStateInPandas(LogState(), outputStructType=told, outputMode="Append", timeMode="None")


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each video."""
    rest = [c for c in versions.columns if c not in ("video", "n")]
    best = F.max_by(F.struct(*rest), "n").alias("v")
    return versions.groupBy("video").agg(best).select("video", "v.*")
