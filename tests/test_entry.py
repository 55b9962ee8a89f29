"""The driver contract."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_on_smoke_data(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert "top_category" in df.columns


def test_queries_and_oracles_line_up():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert "insights" in q and "insights" in o
