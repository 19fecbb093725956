"""Every registered query of the domain against its SQL in DuckDB, over all rows of the smallest test data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from orfspark import queries as q

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _plain(rows, columns):
    return sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


def test_all_have_sql():
    assert set(q.queries()) == set(q.oracle_sql())


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, data, duck, name):
    df = q.queries()[name](spark, data)
    cursor = duck.execute(q.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _plain(cursor.fetchall(), columns) == _plain([tuple(r) for r in df.collect()], df.columns)


def test_the_entry_module_works_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "orfspark", tmp_path / "orfspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'orf_scored' in e.queries() and not any(k.startswith('op') for k in e.oracle_sql())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
