"""Registered queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from tools.check import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
CHECKED = (
    "scan_raw_csv", "upsert_by_key", "extract_cards_z", "extract_cards_a", "detect_repeated_pages", "end_of_results",
    "dedup_by_code", "features_regex_z", "parse_price_text", "impute_group_mean", "map_neighborhood", "iqr_price_then_area",
    "stock_listings", "kpi_report_from_raw", "snapshot_set_diff", "area_distribution", "price_box_stats", "historic_price_m2_series",
    "places_within_radius", "report_request", "trend_values", "deviation_bins", "sample_n", "training_table",
    "write_kpi_json", "write_report", "drop_missing_price_area", "feature_selection", "multicollinearity_filter", "outlier_count",
)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    result = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)


def test_entry(spark):
    assert contract.entry(spark).count() == 19


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
