from __future__ import annotations

import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
OWN = [q for q in entry.queries() if q in entry.oracle_sql() and not re.match(r"p[678]_", q)]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in range(1, 6)} <= set(entry.queries())


def test_core_does_not_need_the_text_package():
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n def find_spec(self, n, p=None, t=None):\n  if n.startswith('tickstone.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p6_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for f in ROOT.glob("tickstone/**/*.py"):
        if "llm" not in f.parts:
            assert "tickstone.llm" not in f.read_text(), f


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False)), cols


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, oracle, name):
    got, cols = _rows(entry.queries()[name](spark, str(DATA)).toPandas())
    want, named = _rows(oracle.execute(entry.oracle_sql()[name]).df())
    assert cols == named and got == want


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started elsewhere, Python workers cannot import the package: functions must travel with their code."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\nfrom tickstone.session import build_session\n"
        "s = build_session('far', 'local[2]', spark__sql__shuffle__partitions=2, spark__ui__enabled='false')\n"
        f"for q in ('p1_grid', 'p2_found', 'p3_found', 'sim_equity'): assert e.queries()[q](s, {str(DATA)!r}).count() > 0, q\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
