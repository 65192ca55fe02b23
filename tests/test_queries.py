"""Registered queries against their SQL at the smallest scale.

One query per family by default; ALL_QUERIES=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare
from small_data import SMALL

FAMILIES = """feature_set feature_ema training_frame attach_peer_features fold_assignment holdout_split
calibration_split topn_weights hold_weights baseline_ma_cross execution_price portfolio_metrics rank_ic
pr_auc validation_summary official_no_data_dates active_asof_fold identity_asof event_clear
micro_kpi_drift parse_symbol_month_payload parse_otc_daily_payload read_tick_archive
explode_payload_records validate_daily_bars upsert_daily_by_source_rank dedupe_company_profiles_report
minute_gap_segments factor_panel cluster_frame peer_overlay audit_sample signal_outcome cost_consistency
strict_run_issues latest_signal_snapshot parameter_sensitivity review_checks run_comparison
kpi_symbol_completeness recovery_drill_result symbol_readiness tick_restore_windows order_screening
stream_tick_landing stream_minute_upsert baseline_metrics microstructure_store""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FAMILIES


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    text, ok = compare(spark, con, SMALL, name)
    assert ok, text


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "total_return", "sharpe", "max_drawdown"]
    assert df.count() == 5


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
