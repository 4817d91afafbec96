import ast
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from personweave.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(repr(r[names.index(c)]) for c in columns) for r in found.fetchall()))
    assert sorted(tuple(repr(r[c]) for c in columns) for r in rows) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "personweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            names = [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names]
            names += [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_contract_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "personweave"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "personweave" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), "False"], said.stderr
