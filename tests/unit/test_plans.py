"""Registered queries against their SQL."""

import duckdb
import pytest

from skyledger.plans import checks, processes, rules, structures
from skyledger.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_samples_of_every_trial(spark):
    rows = sorted(tuple(r) for r in QUERIES["task_samples_all"](spark, SF).select("modelFamily", "taskId", "samples").collect())
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert rows == sorted(db.execute(SQL["task_samples_all"]).fetchall())
    trials = [s.split(":")[0] for r in rows for s in r[2].split(" ")]
    assert sorted(trials) == sorted(str(r.o_orderkey) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect())
    assert {r[0] for r in rows} == {r[0] for r in db.execute("SELECT DISTINCT n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey").fetchall()}


def test_queries_of_single_operators(spark):
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    names = [n for n, f in QUERIES.items() if f.__module__ == checks.__name__]
    assert len(names) > 60
    for name in names:
        df, rel = QUERIES[name](spark, SF), db.sql(SQL[name])
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns), name
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
        assert got and got == sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr), name


@pytest.mark.parametrize("module,least", [(rules, 6), (structures, 7), (processes, 9)])
def test_queries_by_their_sql(spark, module, least):
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    names = [n for n, f in QUERIES.items() if f.__module__ == module.__name__]
    assert len(names) >= least
    for name in names:
        df, rel = QUERIES[name](spark, SF), db.sql(SQL[name])
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns), name
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
        want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr)
        assert got == want and (got or name == "draft_violations"), name
