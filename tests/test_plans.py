"""Plan guards: the physical plans keep the properties the design relies on."""

import pytest

from tallyspark.plans import ORACLE, QUERIES

def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf):
    return {n: plan(spark, sf, n) for n in sorted(ORACLE)}


def test_no_python_in_any_plan(plans):
    bad = [n for n, p in plans.items()
           if "BatchEvalPython" in p or "ArrowEvalPython" in p or "PythonUDF" in p]
    assert not bad


def test_no_cartesian_products(plans):
    assert not [n for n, p in plans.items() if "CartesianProduct" in p]


def test_no_nested_loop_joins(plans):
    assert not [n for n, p in plans.items() if "NestedLoopJoin" in p]


def test_inputs_are_scanned_once(plans):
    for name, scans in {"dashboard_kpis": 1, "expense_summary": 1, "category_trend": 1, "budget_alerts": 3,
                        "forecast_dispatch": 4, "resolve_note_category": 6, "clean_transactions": 6}.items():
        assert plans[name].count("FileScan parquet") <= scans, (name, plans[name].count("FileScan parquet"))


def test_date_filter_reaches_the_scan(spark, sf):
    p = QUERIES["filter_expenses"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p


def test_per_user_top_n_limits_before_the_shuffle(plans):
    for name in ("recent_transactions", "value_counts"):
        p = plans[name]
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_fixed_mappings_need_no_join(plans):
    # the mapping tables are literal map expressions, evaluated in codegen
    for name in ("normalise_payment_mode", "normalise_category"):
        assert "Join" not in plans[name], name


def test_scans_read_only_needed_columns(spark, sf):
    p = QUERIES["monthly_totals"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp" in p \
        or "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate" in p


def test_budget_month_prunes_partitions(spark, sf):
    import tempfile

    from tallyspark.operators.filters import scan_budgets
    from tallyspark.sources.files import write_budgets
    from tallyspark.sources.tables import budgets
    path = tempfile.mkdtemp(prefix="tally-budgets-", dir="/tmp") + "/b"
    write_budgets(budgets(spark, sf), path)
    df = scan_budgets(spark.read.parquet(path), "2024-01")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in p and "2024-01" in p
    assert df.count() == budgets(spark, sf).filter("month = '2024-01'").count()


# windows without a partition run in one task: allowed only over inputs with
# a size bound independent of the data (<= 256 quantile buckets; one row per
# calendar month of the all-user monthly series)
BOUNDED_GLOBAL_WINDOWS = {"describe_amount", "feature_table_monthly", "temporal_holdout",
                          "actual_vs_predicted", "regression_metrics", "seasonal_trend_monthly",
                          "monthly_forecast_seed"}


def _global_window(plan: str) -> bool:
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line or "WindowGroupLimit" in line:
            for nxt in lines[i + 1:i + 4]:
                if "Exchange SinglePartition" in nxt:
                    return True
                if "Window" not in nxt and "Sort" not in nxt and "Project" not in nxt:
                    break
    return False


def test_single_partition_windows_only_over_bounded_inputs(plans):
    found = {n for n, p in plans.items() if _global_window(p)}
    assert found <= BOUNDED_GLOBAL_WINDOWS, found - BOUNDED_GLOBAL_WINDOWS
