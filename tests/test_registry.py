"""Registered queries: each against its SQL, and the entry point without the corpus operators."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from kithmark.plans.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con(sf):
    got = duckdb.connect()
    for f in os.listdir(sf):
        got.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return got


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert Counter(tuple(map(plain, r)) for r in got.select(*columns).collect()) == Counter(tuple(float(x) if type(x).__name__ == "Decimal" else plain(x) for x in r) for r in want)


def test_the_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(QUERIES) > 150


def test_entry_works_without_the_corpus_operators(tmp_path):
    """In a copy without them, as if they had been deleted."""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "kithmark", tmp_path / "kithmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(QUERIES)), "False"], said.stderr
