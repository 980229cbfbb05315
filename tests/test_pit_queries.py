from __future__ import annotations

import inspect

import duckdb
import pytest

import __spark_entry__ as entry
from tickstone.operators.evaluation import train_baseline
from tickstone.plans import pit_queries


def test_a_missing_holding_is_not_hidden_by_another_supplier(spark, tmp_path):
    rows = "(1, TIMESTAMP '1995-01-02'), (2, TIMESTAMP '1995-01-02'), (51, TIMESTAMP '1995-01-03'), (2, TIMESTAMP '1995-01-03'), (51, TIMESTAMP '1995-01-05')"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS FROM (VALUES {rows}) t(l_suppkey, l_shipdate)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    got = sorted((str(r.event_time)[:10], r.symbol) for r in entry.queries()["holdings_missing_panel_c"](spark, str(tmp_path)).collect())
    want = sorted((str(t)[:10], s) for t, s in con.execute(entry.oracle_sql()["holdings_missing_panel_c"]).fetchall())
    assert got == want == [("1995-01-03", "1"), ("1995-01-05", "2")]


def test_the_baseline_is_trained_in_full(spark, monkeypatch):
    class Called(Exception):
        pass

    def called(*args, **named):
        use = inspect.signature(train_baseline).bind(*args, **named)
        use.apply_defaults()
        raise Called(use.arguments["iterations"])

    monkeypatch.setattr(pit_queries, "_split", lambda spark, d: (None, None))
    monkeypatch.setattr(pit_queries, "train_baseline", called)
    with pytest.raises(Called, match="^80$"):
        pit_queries.train_gbt(spark, "")
