"""Registered queries against their SQL in DuckDB, at the smallest scale (which has gaps)."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from aeropanel.plans import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SOME = ["hourly_grid_reindex", "json_column_unpack", "ffill_bfill_covariates", "direct_features_oracle", "test_origins", "tail_metrics", "leaderboard_cells", "eda_ventilation_deciles", "eda_log_hist", "bootstrap_tail_ci", "bootstrap_dmae_ci", "dm_statistic_lag1", "bh_qvalues", "mmcp4d_fit", "mmcp4d_apply", "episode_regime", "coverage_by_method", "paired_coverage_bootstrap", "dm_bootstrap_agreement", "tail_replication", "covariate_slices", "origins_by_horizon", "losses_round_trip", "predictions_round_trip", "trained_counts", "cache_by_content", "error_totals", "refined_quantiles", "pooled_q90", "mmcp_edges", "episode_cuts", "stream_sliding_windows", "stream_sessions", "stream_filled_means", "drift_forecast", "resumed_cells", "manifest_append", "results_round_trip", "metrics_round_trip", "kept_columns", "site_coordinates", "registered_series", "sql_functions", "ridge_of_two_features"]


def canon(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x if x is None or isinstance(x, (int, bool)) else str(x)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    out = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(oracles.oracle_sql()[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(canon(r[c]) for c in columns) for r in out.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(canon(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_flagship(spark):
    got = {r["station"]: r for r in __spark_entry__.entry(spark).where("pollutant = 'no2'").collect()}
    assert got["click"]["mae"] == pytest.approx(43.978086, abs=1e-3) and got["view"]["n"] == 49


def test_every_oracle_has_its_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())
