"""The registered queries against DuckDB, and the entry without the training-text operators."""

from __future__ import annotations

import datetime
import decimal
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from .conftest import ROOT, SMALL

sys.path.insert(0, ROOT)
from lodestar.plans import behaviour, more, queries  # noqa: E402, F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = sorted(k for k, (_, sql) in queries.REGISTRY.items() if sql)


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, small, name):
    f, sql = queries.REGISTRY[name]
    df = f(spark, small)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall())
    assert got == want


def test_entry(spark, small):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and set(E.oracle_sql()) <= set(E.queries())


def test_it_imports_without_the_training_text_operators(tmp_path):
    import shutil

    for x in ("__spark_entry__.py", "lodestar"):
        src = Path(ROOT) / x
        if src.is_dir():
            shutil.copytree(src, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / x)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 50 and not any(k.startswith('op1') or k == 'pipeline' for k in n); e.oracle_sql(); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip().endswith("fine"), done.stderr


def test_the_library_does_not_import_the_llm_package():
    for p in (Path(ROOT) / "lodestar").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lodestar.llm" not in p.read_text() and "from ..llm" not in p.read_text(), p
    assert SMALL
