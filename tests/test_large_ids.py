"""Rows that appear only in larger tables."""

import datetime as dt

import duckdb
import pytest

from harness import compare
from tallyspark.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Expenses with ids on both sides of the million that an insert adds."""
    at = tmp_path_factory.mktemp("events")
    rows = [(i + far, dt.datetime(2024, 1, 1 + i % 9), i % 3, "purchase", float(i), None)
            for far in (0, 1_000_000) for i in range(1, 24)]
    (spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
     .coalesce(1).write.parquet(f"{at}/events.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["expense_versions", "expense_changes_between_versions", "budget_versions"])
def test_inserts_may_bring_ids_that_the_ledger_has(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/events.parquet/*.parquet')")
    out = compare(spark, con, name, QUERIES[name], ORACLE[name], events)
    assert "error" not in out and out["spark_rows"] > 0
