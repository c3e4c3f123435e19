"""Every query of the engine against SQL on the same tables, by DuckDB."""

import glob
import os

import duckdb
import pytest
from compare import rows

from sagitta import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*' * os.path.isdir(p)}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, db, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(Q.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_has_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_text_operators(tmp_path):
    """The entry and the rest of the library work without the subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/sagitta", tmp_path / "sagitta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
