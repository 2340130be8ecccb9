"""Registered queries against their SQL.

Every query runs with FULL=1; without it one or more of each family do.
"""

import os

import __spark_entry__ as entry
import pytest
from compare import difference, duck

NAMES = list(entry.queries())
SHORT = {
    "returns_by_regime", "month_parsing", "quoted_lines", "coerce_numbers", "name_mapping_report", "coalesce_renamed",
    "complete_series", "coverage_with_reason", "duplicate_series", "canonical_panel", "index_checks", "frequency",
    "long_to_wide", "complete_grid", "bucket_median", "bucket_first_last", "exact_quantiles", "quantiles_type8",
    "volatility_clipped", "exponential_average", "interpolate_gaps", "clean_returns", "prepare_indices",
    "hysteresis_states", "regime_spells_merged", "smoothed_states", "transition_matrix", "regime_statistics",
    "flag_overlap", "product_sums", "regime_coefficients", "threshold_search", "half_life_envelope", "group_shares",
    "shock_profiles", "scaled_shocks", "scenario_paths", "draw_bands", "reconciled_scaled", "shapley_exact",
    "mass_report", "index_agreement", "waterfall", "scenario_spec_issues", "latest_per_key", "save_by_index",
}
RUN = NAMES if os.environ.get("FULL") else [n for n in NAMES if n in SHORT]


@pytest.fixture(scope="module")
def con(sf):
    return duck(os.environ.get("SF_DIR", sf))


@pytest.mark.parametrize("name", RUN)
def test_query(spark, sf, con, name):
    got = entry.queries()[name](spark, os.environ.get("SF_DIR", sf)).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert difference(got, con.execute(sql).df()) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_short_list_exists():
    assert SHORT <= set(NAMES)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(NAMES)
