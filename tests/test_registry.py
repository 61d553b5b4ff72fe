"""Registered queries against their SQL, on the smallest driver tables if they are there."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from postern import workload

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def test_every_query_has_sql():
    assert set(workload.queries()) == set(workload.oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(workload.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = workload.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_library_stands_without_the_training_operators(tmp_path):
    """The entry module imports, with the engine's own queries, when the llm folders are gone."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'where_and' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_the_engine_imports_whatever_the_operators_lack():
    """Without a library that only the operators need, the engine's own queries are all there."""
    lacking = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    done = subprocess.run([sys.executable, "-W", "always", "-c", lacking], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", str(len(workload.queries()))], done.stderr
