import datetime as dt

from pyspark.sql import functions as F

from ferrule.operators.ordered import changes
from ferrule.sources.sinks import VersionedTable
from ferrule.streaming import streams

SCHEMA = "id bigint, app_id bigint, status string, at timestamp"
T = dt.datetime(2026, 1, 5)
ROWS = [(1, 1, "a", 0), (2, 2, "a", 1), (3, 1, "a", 2), (4, 1, "b", 20), (5, 2, None, 21), (6, 2, None, 22), (7, 1, "a", 30), (8, 2, "c", 31)]


def files(spark, tmp_path, name="in"):
    path = str(tmp_path / name)
    for i in range(0, len(ROWS), 3):
        part = [(a, b, c, T + dt.timedelta(days=d)) for a, b, c, d in ROWS[i : i + 3]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_status_changes_equal_batch(spark, tmp_path):
    stream, batch = files(spark, tmp_path)
    got = sorted((r.app_id, r.id, r.status) for r in drained(streams.status_changes(stream, "app_id", "id", "status"), tmp_path, "s1"))
    want = sorted((r.app_id, r.id, r.status) for r in changes(batch, "app_id", ["id"], "status").collect())
    assert got == want


def test_first_seen(spark, tmp_path):
    stream, _ = files(spark, tmp_path)
    assert sorted(r.id for r in drained(streams.first_seen(stream, "app_id", "at"), tmp_path, "s2")) == [1, 2]


def test_weekly_counts_begin_on_monday(spark, tmp_path):
    stream, batch = files(spark, tmp_path)
    got = {(r.week_start.date(), r.app_id): r.n for r in drained(streams.weekly_counts(stream, "at", "app_id", "1 days"), tmp_path, "s3")}
    want = {}
    for r in batch.collect():
        k = (r["at"].date() - dt.timedelta(days=r["at"].weekday()), r.app_id)
        want[k] = want.get(k, 0) + 1
    assert got and got.items() <= want.items() and all(k[0].weekday() == 0 for k in got)


def test_upserts_in_batches(spark, tmp_path):
    stream, batch = files(spark, tmp_path)
    table = VersionedTable(spark, str(tmp_path / "t"))

    def merge(current, rows):
        both = current.select("app_id", "id").unionByName(rows.select("app_id", "id"))
        return both.groupBy("app_id").agg(F.max("id").alias("id"))

    q = stream.select("app_id", "id").writeStream.foreachBatch(streams.upsert_into(table, "app_id", merge)).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.app_id: r.id for r in table.read().groupBy("app_id").agg(F.max("id").alias("id")).collect()}
    assert got == {r.app_id: r.id for r in batch.groupBy("app_id").agg(F.max("id").alias("id")).collect()}
