"""Every query with SQL gives the rows of its SQL; the others run with a stable schema."""

import datetime as dt
import random

import duckdb
import pytest

from oracle import connect, difference

import ferrule.plans.queries  # noqa: F401
import ferrule.plans.record_queries  # noqa: F401
from ferrule.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, con, name):
    assert difference(QUERIES[name](spark, small), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_entry_adds_only_what_can_be_imported():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_llm_package():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "ferrule"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "ferrule.llm" not in f.read_text(), f


def test_cooldown_counts_days_exactly_without_a_broadcast(spark, tmp_path):
    """Days around every edge of the blocks; the lookup grows with the applications, so a driver that can hold next to nothing must do."""
    rng, start = random.Random(7), dt.date(2024, 12, 1)
    days = [start + dt.timedelta(n) for n in range(200)]
    jobs = [(f"c{c}", dt.datetime.combine(d, dt.time(rng.choice([0, 23]), 59))) for c in range(9) for d in days for _ in range(2)] + [(None, dt.datetime(2025, 1, 1)), ("c1", None)]
    asked = [(f"c{c}", str(rng.choice(days))) for c in range(8) for _ in range(c)]
    odd = [(None, "2025-01-01"), ("c8", None), ("c8", ""), ("c8", "2025-1-02"), ("c8", "2025-02-30"), ("c8", "2025-01-02\n"), ("c8", "soon"), ("c8", "0001-01-01"), ("c8", "9999-12-31")]
    spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "job_id bigint, company string, first_seen_at timestamp_ntz").write.parquet(f"{tmp_path}/jobs.parquet")
    spark.createDataFrame(asked + odd, "company string, date string").write.parquet(f"{tmp_path}/applications.parquet")
    near = {(c, dt.date.fromisoformat(d) + dt.timedelta(n)) for c, d in asked for n in range(61)}
    want = [i for i, (c, t) in enumerate(jobs) if t and (c, t.date()) in near]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")
    try:
        got = QUERIES["f10_cooldown"](spark, str(tmp_path))
        assert sorted(r.job_id for r in got.collect()) == want
        sql = duckdb.connect()
        for t in ("jobs", "applications"):
            sql.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        assert difference(got, sql, SQL["f10_cooldown"]) == ""
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
