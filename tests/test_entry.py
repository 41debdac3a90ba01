"""Every query of the rest against its SQL, and the driver's contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from kavram.plans.queries import QUERIES, SQL

from .conftest import HERE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = duck.execute(f'SELECT {", ".join(f"{chr(34)}{c}{chr(34)}" for c in columns)} FROM ({SQL[name]})').fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "n_tokens", "n_chunks"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("gone", [{"llm", "corpus_pipeline.py"}, {"llm"}])
def test_without_the_optional_parts(tmp_path, gone):
    shutil.copytree(HERE, tmp_path / "r", ignore=lambda d, names: ({".git", "__pycache__"} | gone) & set(names))
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(SQL))], said.stderr[-500:]
