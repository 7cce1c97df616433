"""Language, queue accounting and the paged source."""

import json

from quarry.functions import language
from quarry.operators import queue
from quarry.sources.paged import PagedLog


def test_language_by_words(spark):
    texts = ["The cat is on the mat and it was the best of all that we have seen in this house for a long time, with joy to all.", "Der Hund und die Katze sind nicht mit dem Mann auf der Straße, und das ist ein Bild von der Stadt, die zu den Bergen führt.", "short text", "zzz qqq " * 30, None]
    rows = spark.createDataFrame([(i, t, '<html lang="fr-CA">' if i % 2 == 0 else "") for i, t in enumerate(texts)], "i int, x string, h string")
    got = rows.select("i", language.by_words("x").alias("w"), language.language("x", "h").alias("l")).orderBy("i").collect()
    assert [r.w for r in got] == ["en", "de", None, None, None] and [r.l for r in got] == ["en", "de", "fr-ca", "", "fr-ca"]


def test_queue_accounting(spark):
    calls = [("q", float(i), "enqueue", i, 0) for i in range(6)] + [
        ("q", 10.0, "dequeue", 1, 2), ("q", 11.0, "complete", 1, 0), ("q", 12.0, "dequeue", 2, 2), ("q", 13.0, "fail", 2, 0), ("q", 14.0, "dequeue", 3, 1), ("q", 40.0, "dequeue", 9, 0), ("p", 0.0, "dequeue", 1, 5), ("p", 1.0, "complete", 7, 0),
    ]
    rows = spark.createDataFrame(calls, "queue string, t double, call string, id long, n long")
    got = {r.queue: tuple(r)[1:] for r in queue.replay(rows, capacity=5, batch_s=20.0).collect()}
    # six come, one is dropped; two done; two fail and come back; the batch of one stays out too long and comes back
    assert got == {"q": (3, 0, 5, 2, 1, 0, 3), "p": (0, 0, 0, 0, 0, 0, 0)}
    late = queue.replay(rows.where("call = 'enqueue' or t = 40"), item_s=30.0).first()
    assert (late.expired, late.waiting) == (6, 0)


def test_queue_accounting_matches_a_plain_replay(spark):
    """The registered query against a replay that keeps every call in a list, without a queue's data structures."""
    from quarry.plans import registry

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    want = {}
    for queue_id in {r.user_id % 16 for r in events}:
        line, out, taken, done, dropped, expired, back = [], [], 0, 0, 0, 0, 0  # line: [time, item]; out: [time, batch, items]
        for r in (x for x in events if x.user_id % 16 == queue_id):
            now = r.ts.timestamp()
            for late in [b for b in out if now - b[0] > 3600.0]:
                out.remove(late)
                line[:0] = late[2]
                back += len(late[2])
            while line and now - line[0][0] > 86_400.0:
                line.pop(0)
                expired += 1
            if r.event_type == "purchase":
                if items := [line.pop(0) for _ in range(min(4, len(line)))]:
                    out.append([now, r.event_id, items])
                    taken += len(items)
            elif r.event_type == "error":
                for b in [b for b in out if b[1] == r.event_id]:
                    out.remove(b)
                    line[:0] = b[2]
                    back += len(b[2])
            elif len(line) >= 50:
                dropped += 1
            else:
                line.append([now, r.event_id])
        want[str(queue_id)] = (len(line), sum(len(b[2]) for b in out), taken, done, dropped, expired, back)
    got = {r.queue: tuple(r)[1:] for r in registry.QUERIES["queue_accounting"](spark, sf).collect()}
    assert got == want


def test_throttle_streams_through_batches(spark):
    from pyspark.sql import functions as F

    from quarry.operators import current

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 2).alias("t"))
        out = current.throttle(rows, "k", "t", 13.0).orderBy("k", "at").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for r in out:
        now = r.at.timestamp()
        ok = now - last.get(r.k, float("-inf")) >= 13
        assert r.accepted == ok and (r.wait_s is None if ok else abs(r.wait_s - (last[r.k] + 13 - now)) < 1e-6)
        last[r.k] = now if ok else last[r.k]


def test_batches_of_skewed_ids(spark):
    from pyspark.sql import functions as F

    from quarry.operators import current

    rows = spark.range(1000).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.col("id") * 10**12).alias("id"))
    for cells in (None, 5, 700):
        got = {r.id: r.batch_id for r in current.batches(rows, "id", 10, cells).collect()}
        assert [got[i] for i in sorted(got)] == [i // 10 for i in range(1000)]


def test_paged_source(spark, tmp_path):
    (tmp_path / "get-sth").write_text(json.dumps({"tree_size": 7}))
    for a in (0, 3):
        (tmp_path / f"get-entries?start={a}&end={a + 2}").write_text(json.dumps({"entries": [{"leaf_input": f"x{i}"} for i in range(a, a + 3)]}))
    spark.dataSource.register(PagedLog)
    stream = spark.readStream.format("paged_log").option("logs", str(tmp_path)).option("page", 3).load()
    query = stream.writeStream.format("memory").queryName("paged").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.idx, r.leaf_input) for r in spark.table("paged").orderBy("idx").collect()] == [(i, f"x{i}") for i in range(6)]
