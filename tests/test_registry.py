"""Every registered query against its SQL on the smallest tables, and the entry without the training-data operators."""

import shutil
import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT, SF
from quillstone import plans
from quillstone.plans import registry

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple("null" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))

    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df())


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry_works_without_the_training_data_operators(tmp_path):
    for p in ("quillstone", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "quillstone/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'ev_page_newest' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path)})
