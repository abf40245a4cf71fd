"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")
CORPUS = {n for n in __spark_entry__.queries() if n == "pipeline" or n[:2] == "op" and n[2:3].isdigit()}


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(n for n in set(__spark_entry__.oracle_sql()) - CORPUS))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    at = [want.columns.index(c) for c in columns]
    key = lambda t: tuple((v is not None, str(type(v)), v) for v in t)
    mine = sorted((tuple(near(x[c]) for c in columns) for x in got.collect()), key=key)
    theirs = sorted((tuple(near(x[i]) for i in at) for x in want.fetchall()), key=key)
    assert mine == theirs


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for f in ("__spark_entry__.py", "tessera"):
        (tmp_path / f).symlink_to(ROOT / f) if f.endswith(".py") else None
    (tmp_path / "tessera").mkdir()
    for f in (ROOT / "tessera").iterdir():
        if f.name not in ("llm", "__pycache__"):
            (tmp_path / "tessera" / f.name).symlink_to(f)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert 'compact_gpu' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    for missing in ("", "import sys; sys.modules['xxhash'] = None; "):  # with the folders gone, and here without a library that they need
        where = ROOT if missing else tmp_path
        subprocess.run([sys.executable, "-c", missing + code], cwd=where, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(where), "PYTHONDONTWRITEBYTECODE": "1"})
