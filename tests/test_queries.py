"""Every registered query against DuckDB where SQL can say it, else that it runs with rows."""

import os
import shutil
import subprocess
import sys

import pytest
from tests.conftest import same

from pointloom.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, duck.sql(SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_text_operators(tmp_path):
    """A copy without the llm folders imports and registers everything else, the pipeline's file being there or not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL)), "False"]
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
