"""Every query of the catalogue against its SQL on the smallest tables, and the driver's contract."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from nearfield.plans import catalog, types  # noqa: F401

from .parity import connect, rows

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_library_does_not_import_the_corpus_operators():
    for path in (ROOT / "nearfield").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"nearfield\.llm|from nearfield import llm", path.read_text()), path


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("nearfield", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "nearfield" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr
