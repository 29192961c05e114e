import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import key
from parapheur.plans.oracle import ORACLE
from parapheur.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(map(key, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = db.execute(ORACLE[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    assert got == sorted(tuple(key(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry_runs(spark, data):
    assert entry.entry(spark).count() == 2
    assert set(ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_optional_subpackage():
    for path in (ROOT / "parapheur").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("parapheur.llm") for n in names), path
