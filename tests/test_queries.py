"""Registered queries against their SQL in DuckDB, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltmark.plans.queries import ORACLES, QUERIES
from tests.compare import normal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    assert normal(QUERIES[name](spark, sf_dir).toPandas()).equals(normal(duck.sql(ORACLES[name]).df()))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].change_risk >= rows[-1].change_risk
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_library_does_not_need_the_corpus_package():
    import ast
    from pathlib import Path

    root = Path(entry.__file__).parent / "siltmark"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("siltmark.llm" in n for n in names), path
