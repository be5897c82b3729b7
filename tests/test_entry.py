import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tracery.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value if isinstance(value, int | bool) or value is None else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    rows = lambda columns, data: sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in data)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("left", [("corpus_pipeline.py",), ()])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, left):
    for name in ("__spark_entry__.py", "tracery", *left):
        if (ROOT / name).exists():
            subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tracery/llm"], check=True)
    code = "import __spark_entry__ as e; assert 'q_star_evidence_rows' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
