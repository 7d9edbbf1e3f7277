"""Stages that are found again, and made again where something before them changed."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import functions as F

from shotweave.sources.stages import StageStore


@dataclass
class P:
    factor: int
    more: tuple = ()


def run(store, source, factor=2, least=3, built=None, version=1):
    def scaled(rows):
        built.append("scaled")
        return rows.select((F.col("id") * factor).alias("x"))

    def kept(rows):
        built.append("kept")
        return rows.where(F.col("x") >= least)

    def counted(a, b):
        built.append("counted")
        return a.unionByName(b)

    rows = store.source(source)
    a = store.stage("scaled", scaled, [rows], P(factor))
    b = store.stage("kept", kept, [a], {"least": least})
    return store.stage("both", counted, [a, b], version=version)


def test_only_what_changed_is_made_again(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "stages")
    spark.range(5).write.parquet(source)

    def made(**change):
        built = []
        out = run(StageStore(spark, root), source, built=built, **change)
        return built, sorted(r.x for r in out.rows.collect())

    assert made() == (["scaled", "kept", "counted"], [0, 2, 4, 4, 6, 6, 8, 8])
    assert made() == ([], [0, 2, 4, 4, 6, 6, 8, 8])  # another session
    assert made(least=5) == (["kept", "counted"], [0, 2, 4, 6, 6, 8, 8])
    assert made(version=2)[0] == ["counted"]
    assert made(factor=3)[0] == ["scaled", "kept", "counted"]
    assert made(least=5)[0] == []
    spark.range(5, 6).write.mode("append").parquet(source)
    assert made()[0] == ["scaled", "kept", "counted"]


def test_half_written_results_are_made_again_and_old_ones_go(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "stages")
    spark.range(5).write.parquet(source)
    run(StageStore(spark, root), source, built=[])
    kept = next((tmp_path / "stages" / "kept").iterdir())
    (kept / "_SUCCESS").unlink()
    spark.range(3).selectExpr("id AS x").write.mode("append").parquet(str(kept))
    (kept / "_SUCCESS").unlink()
    built = []
    store = StageStore(spark, root)
    assert sorted(r.x for r in run(store, source, built=built).rows.collect()) == [0, 2, 4, 4, 6, 6, 8, 8]
    assert built == ["kept"]
    run(StageStore(spark, root), source, least=7, built=[])
    count = lambda: sum(1 for _ in Path(root).glob("*/*"))
    assert count() == 5
    assert store.prune(keep=1) == [] and len(store.prune()) == 2 and count() == 3
    built = []
    run(StageStore(spark, root), source, built=built)
    assert built == []
