"""Each query over the smallest tables, against its SQL; also that nothing but the corpus operators needs their subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from pagelens.plans import catalog, more

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def normal(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


ALL, ORACLES = catalog.QUERIES | more.QUERIES, catalog.ORACLE_SQL | more.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    df = ALL[name](spark, DATA)
    cols = sorted(df.columns)
    got = normal(tuple(r[c] for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    q = con.execute(ORACLES[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == normal(tuple(r[i] for i in at) for r in q.fetchall()) and got


def test_imports_without_the_corpus_operators(tmp_path):
    import shutil

    for p in ("__spark_entry__.py", "pagelens"):
        src = ROOT / p
        shutil.copytree(src, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
