"""Every query against its DuckDB equivalent on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"

# Queries that lean on ordered blocks in different ways, run once more with every frame cut into blocks.
IN_BLOCKS = [
    "agg1_content_profile", "agg24_otsu_threshold", "agg46_anchor_coverage", "cld4_percentile_clip", "jon6_asof_interp_clamped",
    "txt9_numbering", "win5_edge_summary", "win16_log_attempts", "agg6_median_range", "agg22_veil_score", "agg51_fifteen_populations",
    "jon8_nearest_gap", "jon14_points_in_hull", "win6_corridor_passes", "win18_greedy_spacing", "win20_adjacent_groups", "rpt9_stationary_detail",
    "rpt1_registration", "rpt7_repeat_runs", "rpt8_tail_runs", "rpt12_sweep_values",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", IN_BLOCKS)
def test_query_in_blocks(split, con, name):
    assert compare(queries()[name](split, SF), con, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
