import math

import duckdb
import pytest

from panelweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_like_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    q = db.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(q.columns)
    a = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    at = [q.columns.index(c) for c in cols]
    b = [tuple(plain(r[i]) for i in at) for r in q.fetchall()]
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    for x, y in zip(sorted(a, key=order), sorted(b, key=order), strict=True):
        assert all(p == q or isinstance(p, float) and abs(p - q) <= 1e-4 * max(1, abs(q)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_has_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_scans_are_narrow(spark):
    plan = catalog.queries()["dedup_keep_first"](spark, DATA)._jdf.queryExecution().toString()
    assert "o_clerk" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double" in plan
    plan = catalog.queries()["anti_orderless_customers"](spark, DATA)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline_too):
    """The entry file works in a copy of the repository without their folders, with and without the pipeline module."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "panelweave", tmp_path / "panelweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline_too:
        if (here / name).exists():
            shutil.copy(here / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
