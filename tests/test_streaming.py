"""Streams run to their end over files in a temporary folder."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from quarry.operators import current
from quarry.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "domain string, enriched_at timestamp, n int, id int"


def put(spark, path, rows):
    spark.createDataFrame([(d, T0 + dt.timedelta(seconds=s), n, i) for d, s, n, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


@pytest.fixture
def source(spark, tmp_path):
    path = f"{tmp_path}/in"
    put(spark, path, [("a", 0, 1, 1), ("b", 1, 1, 2), ("a", 2, 1, 3)])
    put(spark, path, [("a", 5, 1, 4), ("c", 6, 120, 5), ("c", 4000, 1, 6)])
    return path


def test_first_of_key(spark, source):
    out = drain(jobs.first_of_key(jobs.files(spark, source, SCHEMA), "domain", "enriched_at"), "firsts")
    assert sorted(r.domain for r in out.collect()) == ["a", "b", "c"]


def test_rates_close_when_late_rows_cannot_come(spark, source):
    out = drain(jobs.rates(jobs.files(spark, source, SCHEMA), "enriched_at"), "rates")
    assert [(r.start, r.cnt) for r in out.collect()] == [(T0, 5)]


def test_platforms(spark, source):
    out = drain(jobs.platforms(jobs.files(spark, source, SCHEMA), "domain", "enriched_at", "n"), "platforms", "update")
    last = {r.k: r for r in out.collect()}
    assert last["c"].is_platform and last["c"].max_subdomains == 120 and not last["a"].is_platform and last["a"].cert_count == 3


def test_log_and_current_view(spark, source, tmp_path):
    stream = jobs.files(spark, source, SCHEMA, 1)
    query = jobs.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/c1", lambda x: x.withColumn("seen", F.lit(1)), "0 seconds")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
    query = jobs.keep_current(jobs.files(spark, source, SCHEMA, 1), f"{tmp_path}/view", f"{tmp_path}/c2", tie="id")
    query.processAllAvailable()
    query.stop()
    assert {(r.domain, r.id) for r in jobs.current_view(spark, f"{tmp_path}/view").collect()} == {("a", 4), ("b", 2), ("c", 6)}
    assert jobs.newest_buckets(spark, f"{tmp_path}/none") == {}
    months = [x for x in os.listdir(f"{tmp_path}/log") if x.startswith("enriched_month=")]
    assert months == ["enriched_month=202401"] and sorted(os.listdir(f"{tmp_path}/log/enriched_month=202401")) == ["batch=0", "batch=1"]


def test_current_view_ignores_what_is_unfinished_and_expires(spark, tmp_path):
    view, n = f"{tmp_path}/view", 5
    for i in range(n):
        put(spark, f"{tmp_path}/in", [("a", i, 1, i), (f"k{i}", i, 1, 100 + i)])
        jobs.keep_current(jobs.files(spark, f"{tmp_path}/in", SCHEMA, 1), view, f"{tmp_path}/c", tie="id", buckets=4).awaitTermination()
    want = {("a", n - 1), *((f"k{i}", 100 + i) for i in range(n))}
    assert {(r.domain, r.id) for r in jobs.current_view(spark, view).collect()} == want
    held = {}
    for version, bucket, _ in jobs._versions(spark, view)[1]:
        held[bucket] = held.get(bucket, 0) + 1
    assert max(held.values()) <= 2
    versions = {v for v, _, _ in jobs._versions(spark, view)[1]}
    assert {int(x.split("=")[1]) for x in os.listdir(view)} == versions  # folders without a bucket go
    # a version that is being written has no mark yet
    newest = max(os.listdir(view))
    shutil.copytree(f"{view}/{newest}", f"{view}/version={n + 7:012d}", ignore=shutil.ignore_patterns("_SUCCESS*"))
    assert {(r.domain, r.id) for r in jobs.current_view(spark, view).collect()} == want


def test_throttle_and_quota_remember_between_batches(spark, tmp_path):
    for part in ([("a", 0, 1, 1), ("a", 4, 1, 2)], [("a", 9, 1, 3), ("a", 12, 1, 4), ("b", 12, 1, 5)]):
        put(spark, f"{tmp_path}/in", part)
    source = jobs.files(spark, f"{tmp_path}/in", SCHEMA, 1)
    got = sorted((r.k, (r["at"] - T0).seconds, r.accepted, r.wait_s) for r in jobs.drained(jobs.throttled(source, "domain", "enriched_at", 10.0)).collect())
    assert got == [("a", 0, True, None), ("a", 4, False, 6.0), ("a", 9, False, 1.0), ("a", 12, True, None), ("b", 12, True, None)]
    allowed = sorted((r.k, (r["at"] - T0).seconds, r.allowed) for r in jobs.drained(jobs.quota(source, "domain", "enriched_at", 3)).collect())
    assert allowed == [("a", 0, True), ("a", 4, True), ("a", 9, True), ("a", 12, False), ("b", 12, True)]


def test_quota_counts_many_intervals_together_and_forgets_them(spark, tmp_path):
    rows = [(f"u{i % 1500}" if i % 7 else None, T0 + dt.timedelta(seconds=i // 12), 1, i) for i in range(6000)] + [(k, None, 1, 6000 + i) for i, k in enumerate(["a", None, "a", "a", "b"])]
    parts = [rows[:2500], rows[2500:4000] + rows[6000:6003], rows[4000:6000] + rows[6003:]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = jobs.files(spark, f"{tmp_path}/in", SCHEMA, 1)
    got = jobs.drained(jobs.quota(source, "domain", "enriched_at", 2))
    want = current.quota(spark.createDataFrame(rows, SCHEMA), "domain", "enriched_at", "id", F.lit(2))
    tuples = lambda df, *names: sorted(map(str, df.select(*names).toPandas().itertuples(index=False, name=None)))
    assert tuples(got, "k", "bucket", "at", "allowed") == tuples(want.withColumn("bucket", F.col("bucket").cast("long")), "domain", "bucket", "enriched_at", "allowed")
    put(spark, f"{tmp_path}/in", [("z", 7200, 1, 1)])
    query = jobs.quota(source, "domain", "enriched_at", 2).writeStream.foreachBatch(lambda batch, _: batch.count()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert max(states) <= 512 and states[-1] <= 4  # at most one for each group; in the end those of z and of requests without a time


def test_a_table_is_refreshed_and_kept_on_failure(spark):
    now, answers = [0.0], [spark.range(1), spark.range(2), None]

    def read():
        found = answers.pop(0)
        if found is None:
            raise OSError("not there")
        return found

    held = jobs.Refreshing(read, 60, lambda: now[0])
    assert held().count() == 1
    now[0] = 59
    assert held().count() == 1
    now[0] = 61
    assert held().count() == 2
    now[0] = 200
    assert held().count() == 2 and held.failures == 1
