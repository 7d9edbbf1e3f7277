"""The driver contract, and a cross-section of queries against the SQL that goes with them."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")

SOME = [
    "frame_threshold_runs", "merge_short_shots", "shots_from_cuts", "nearest_cut", "transition_kind", "missing_fill", "format_ids", "band_pairs", "coherence_topk", "depth_climb", "scene_segmentation", "unique_shots_components", "coverage_overflow",
    "frame_nms", "scene_catalogue", "type_occurrences", "venue_gating", "review_precision_sets", "review_threshold_sweep", "role_overlap", "dataset_fingerprint", "boundary_edit", "best_threshold_f1", "model_boundaries", "batch_sessions",
    "correction_replay", "commercial_result", "run_counters", "taxonomy_prompts_hash", "hybrid_boundaries", "pooled_lovo_f1", "wins_losses", "boundary_features_16", "examples_from_labels",
]


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_sql(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = tables.sql(__spark_entry__.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted("|".join(cell(r[n]) for n in names) for r in df.collect())
    at = [want.columns.index(n) for n in names]
    assert got == sorted("|".join(cell(r[i]) for i in at) for r in want.fetchall())
    assert got


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "scene_id" in df.columns


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_only_queries_run(spark):
    queries = __spark_entry__.queries()
    for name in ("boundary_match", "unique_shots_average_linkage", "stream_sessions", "stream_segmenter"):
        assert queries[name](spark, SF).count() > 0, name
