"""Queries against their SQL on the smallest tables, and the library without its optional part."""

import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ("classify_fields", "mask_lookup", "order_series", "spacing_outliers", "varying_value", "decodability", "frame_range")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    from metaudit.plans.oracles import ORACLES
    from metaudit.plans.queries import QUERIES

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in found.collect())
    rows = con.execute(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in rows.fetchall())


def test_every_query_has_sql():
    from metaudit.plans.oracles import ORACLES
    from metaudit.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_works_without_the_optional_part(tmp_path):
    for name in ("metaudit", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "metaudit").mkdir()
    for name in os.listdir(f"{ROOT}/metaudit"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/metaudit/{name}", tmp_path / "metaudit" / name)
    code = "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 30, e.queries()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path), "PYTHONSAFEPATH": "1"}
    # A copy, as Python resolves the link of a script to its real folder.
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
