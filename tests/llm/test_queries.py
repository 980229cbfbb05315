from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tickstone.llm.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    got = QUERIES[name](spark, str(DATA)).toPandas()
    want = con.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(want)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["p6_matches", "p7_shares", "p7_reached", "p8_subjects", "p8_composition"])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_clean_documents_are_those_without_leaks(spark):
    found = {r.doc_id for r in QUERIES["p6_found"](spark, str(DATA)).collect()}
    kept = {r.doc_id for r in QUERIES["p6_clean"](spark, str(DATA)).collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert kept == every - found


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started elsewhere, Python workers cannot import the package: functions and models must travel as plain code and values."""
    root = Path(__file__).resolve().parent.parent.parent
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from tickstone.llm.queries import QUERIES\nfrom tickstone.session import build_session\n"
        "s = build_session('far', 'local[2]', spark__sql__shuffle__partitions=2, spark__ui__enabled='false')\n"
        f"for q in ('p6_found', 'p7_shares', 'p8_found'): assert QUERIES[q](s, {str(DATA)!r}).count() > 0, q\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
