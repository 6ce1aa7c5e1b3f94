"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from molsurf.operators import bench
from molsurf.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    f = frame[columns].astype(object)
    return sorted(map(repr, f.where(f.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, db, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["pair_intersections", "exposed_area_by_atom", "triangles"])
def test_cell_joins_are_equi_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_only_its_columns(spark, sf_dir):
    plan = QUERIES["bench_numeric_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan


def test_unmatched_cases_come_from_all_records(spark, sf_dir, monkeypatch):
    runs = []
    monkeypatch.setattr(bench, "unmatched", lambda *r: runs.extend(r) or r[0])
    QUERIES["bench_unmatched"](spark, sf_dir)
    ids = [r["event_id"] for run in runs for r in run.select("event_id").collect()]
    assert sorted(ids) == sorted(r["event_id"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    monkeypatch.undo()
    assert {r["side"] for r in QUERIES["bench_unmatched"](spark, sf_dir).select("side").collect()} == {"baseline", "current"}
