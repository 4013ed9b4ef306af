import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from kinotable.plans import containers, tables


@pytest.mark.parametrize("name", list(tables.QUERIES))
def test_kernel_query(name, against_sql):
    against_sql(tables.QUERIES[name], tables.SQL[name])


@pytest.mark.parametrize("name", list(containers.QUERIES))
def test_container_query(name, against_sql):
    against_sql(containers.QUERIES[name], containers.SQL[name])


def test_every_query_has_sql():
    assert set(tables.QUERIES) == set(tables.SQL) and set(containers.QUERIES) == set(containers.SQL)


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_works_without_training_data_operators(tmp_path):
    here = Path(__file__).parent.parent
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    said = "import __spark_entry__ as e; q = e.queries(); assert q.keys() == e.oracle_sql().keys() and 'pipeline' not in q; print(len(q))"
    for name in ("corpus_pipeline.py", ""):  # there, and gone too
        out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120, check=True)
        assert int(out.stdout) == len(tables.QUERIES) + len(containers.QUERIES)
        if name:
            (tmp_path / "copy" / name).unlink()
