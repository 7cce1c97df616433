"""Structured Streaming: from certificate records to the log and its current view."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.current import latest, month


_MADE: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``), deleted when the process ends; a local session may leave that unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarry-")
        _MADE.append((spark, path))
    made = f"{path.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    _MADE.append((spark, made))
    return made


def _clean() -> None:
    for spark, path in _MADE:
        try:
            if "://" not in path and not path.startswith("file:"):
                shutil.rmtree(path, ignore_errors=True)
            elif spark.sparkContext._jsc is not None:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the process ends anyway
            pass


atexit.register(_clean)


def files(spark: SparkSession, path: str, schema, per_trigger: int = 64, form: str = "parquet") -> DataFrame:
    """A folder as an unbounded source; ``per_trigger`` bounds what a batch takes in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(form).load(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives out until it has read all there is now, with the ``batch`` it came in; kept in a folder of its own."""
    spark = stream.sparkSession
    path = work_dir(spark)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")


def unexpired(stream: DataFrame, at: str, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """Rows that have not waited longer than ``hours``.

    With :func:`files` (its ``per_trigger`` bounds what is out at a time) and a
    checkpoint, which hands out a failed batch again, this is the work queue.
    """
    return stream.where(F.col(at) >= (F.current_timestamp() if as_of is None else as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def first_of_key(stream: DataFrame, key: str, at: str, lifetime: str = "14 days") -> DataFrame:
    """The first row of a key; its state is forgotten after ``lifetime``, which bounds it."""
    return stream.withWatermark(at, lifetime).dropDuplicatesWithinWatermark([key])


def rates(stream: DataFrame, at: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows in each interval, given out once it is complete."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("cnt"))
    return counted.select(F.col("w.start").alias("start"), "cnt")


def platforms(stream: DataFrame, key: str, at: str, subdomains: str, per_hour: float = 20.0, many: int = 100, age: int = 3600, lifetime: str = "14 days") -> DataFrame:
    """Keys that behave like hosting platforms, with count, widest name and age; state expires after ``lifetime`` without a row."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(name, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        count, widest, first = state.get if state.exists else (0, 0, None)
        last = first
        for rows in batches:
            count += len(rows)
            widest = max(widest, int(rows["n"].max()))
            low, high = float(rows["t"].min()), float(rows["t"].max())
            first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
        state.update((count, widest, first))
        state.setTimeoutTimestamp(int(max(last * 1000, state.getCurrentWatermarkMs()) + keep_ms))
        span = last - first
        flagged = span >= age and (count / max(span / 3600, 0.01) >= per_hour or widest >= many)
        yield pd.DataFrame({"k": [name[0]], "cert_count": [count], "max_subdomains": [widest], "age_s": [span], "is_platform": [flagged]})

    keep_ms = int(lifetime.split()[0]) * 86_400_000
    narrow = stream.withWatermark(at, lifetime).select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.coalesce(F.col(subdomains).cast("int"), F.lit(0)).alias("n"), at).withColumn("t", F.col("us") / 1e6)
    return narrow.groupBy("k").applyInPandasWithState(update, "k string, cert_count long, max_subdomains int, age_s double, is_platform boolean", "cert_count long, widest int, first double", "update", GroupStateTimeout.EventTimeTimeout)


def throttled(stream: DataFrame, key: str, at: str, gap: float, lifetime: str = "1 hour") -> DataFrame:
    """``k, at, accepted, wait_s`` of a stream of requests: as in the batch operator, in the order of each micro-batch.

    A key's state is one time; it is forgotten once the watermark has passed it by ``lifetime``.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    step, keep_ms = int(round(gap * 1e6)), _ms(lifetime)

    def walk(name, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        us = np.sort(np.concatenate([rows["us"].to_numpy(np.int64) for rows in batches]))
        wait = np.zeros(len(us), np.int64)
        i = 0
        while i < len(us):
            if last is not None:
                free = int(np.searchsorted(us, last + step))
                wait[i:free] = last + step - us[i:free]
                i = max(i, free)
            if i < len(us):
                last = int(us[i])
                i += 1
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + keep_ms + step // 1000)
        yield pd.DataFrame({"k": name[0], "us": us, "wait": wait})

    narrow = stream.withWatermark(at, lifetime).select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), at)
    walked = narrow.groupBy("k").applyInPandasWithState(walk, "k string, us long, wait long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return walked.select("k", F.timestamp_micros("us").alias("at"), (F.col("wait") == 0).alias("accepted"), F.when(F.col("wait") > 0, F.col("wait") / 1e6).alias("wait_s"))


#: A missing time, and a count that is kept for good.
_NEVER, _FOREVER = -(1 << 63), (1 << 63) - 1


def quota(stream: DataFrame, user: str, at: str, limit: int, seconds: int = 60, lifetime: str = "10 minutes", groups: int = 512) -> DataFrame:
    """``k, bucket, at, allowed``: is the request among the first ``limit`` of its user's fixed interval?

    Users' intervals are dealt to ``groups`` by hash (the same number as long as a
    checkpoint is used).  A group's rows are counted together and its state holds
    a count for each open interval, so Python is called for each group, not for
    each interval.  Requests without a time share one interval, which stays open.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    keep_ms = _ms(lifetime) + seconds * 1000
    fields = pa.schema([("k", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()), ("until", pa.int64())])

    def walk(name, batches, state: GroupState):
        now = state.getCurrentWatermarkMs()
        held = pa.ipc.open_stream(bytes(state.get[0])).read_all() if state.exists else fields.empty_table()
        held = held.filter(pa.array(held["until"].to_numpy() > now))
        users, buckets, n, until = held["k"].to_pandas(), *(held[c].to_numpy() for c in ("bucket", "n", "until"))
        if not state.hasTimedOut:
            parts = [(rows["k"], rows["bucket"].to_numpy(np.int64), rows["us"].to_numpy(np.int64)) for rows in batches]
            k, bucket, us = pd.concat([p[0] for p in parts], ignore_index=True), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            # places of intervals: those held first, in their order
            who, names = pd.factorize(pd.concat([users.astype(object), k.astype(object)], ignore_index=True), use_na_sentinel=False)
            when, starts = pd.factorize(np.concatenate([buckets, bucket]))
            place, pairs = pd.factorize(who.astype(np.int64) * len(starts) + when)
            place = place[len(n) :]
            had = np.concatenate([n, np.zeros(len(pairs) - len(n), np.int64)])
            came = np.bincount(place, minlength=len(pairs))
            order = np.lexsort((us, place))
            nth = np.empty(len(us), np.int64)
            nth[order] = np.arange(len(us)) - np.repeat(np.cumsum(came) - came, came)
            users, buckets, n = pd.Series(np.asarray(names, object)[pairs // len(starts)], dtype=object), starts[pairs % len(starts)], had + came
            renewed = np.where(buckets == _NEVER, _FOREVER, np.maximum(np.where(buckets == _NEVER, 0, buckets) * seconds * 1000, now) + keep_ms)
            until = np.where(came > 0, renewed, np.concatenate([until, np.zeros(len(pairs) - len(until), np.int64)]))
            yield pd.DataFrame({"k": k, "bucket": bucket, "us": us, "allowed": had[place] + nth < limit})
        if not len(n):
            state.remove()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, fields) as out:
            out.write_table(pa.table([pa.array(users, pa.string(), from_pandas=True), buckets, n, until], schema=fields))
        state.update((sink.getvalue().to_pybytes(),))
        if until.min() < _FOREVER:
            state.setTimeoutTimestamp(int(until.min()))

    narrow = stream.withWatermark(at, lifetime).select(F.col(user).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), at)
    keyed = narrow.withColumn("bucket", F.floor(F.col("us") / F.lit(seconds * 1_000_000)).cast("long"))
    dealt = keyed.select(F.pmod(F.xxhash64("k", "bucket"), F.lit(groups)).alias("dealt"), "k", *[F.coalesce(c, F.lit(_NEVER)).alias(c) for c in ("bucket", "us")], at)
    walked = dealt.groupBy("dealt").applyInPandasWithState(walk, "k string, bucket long, us long, allowed boolean", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    known = lambda c: F.when(F.col("us") != _NEVER, c)
    return walked.select("k", known(F.col("bucket")).alias("bucket"), known(F.timestamp_micros("us")).alias("at"), "allowed")


def _ms(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def append_log(stream: DataFrame, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] = lambda x: x, every: str | None = "5 seconds", key: str = "domain", at: str = "enriched_at") -> StreamingQuery:
    """Append enriched batches to the log as ``enriched_month=../batch=N``; without ``every``, what is there is taken and the query ends.

    A batch that is run again after a failure overwrites its own folders
    instead of doubling rows; months can be pruned and dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = enrich(batch).withColumns({"enriched_month": month(at), "batch": F.lit(number).cast("long")})
        sorted_ = rows.repartition("enriched_month", key).sortWithinPartitions("enriched_month", key, at)
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("enriched_month", "batch").parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: The current view's rows are dealt to this many buckets by key; a batch rewrites those that its keys fall in.
BUCKETS = 64


def keep_current(stream: DataFrame, path: str, checkpoint: str, key: str = "domain", at: str = "enriched_at", tie: str | None = None, buckets: int = BUCKETS, every: str | None = None) -> StreamingQuery:
    """Maintain the newest row of each key as ``path/version=N/bucket=B``.

    A batch writes the buckets that it touches, from their last finished
    versions below its own number; a batch run again rewrites its own.  Of a
    bucket the last two versions stay, so a reader of the one before is not cut off.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        held = rows.persist()
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
        before = {b: v for b, v in newest_buckets(spark, path, number).items() if b in touched}
        if before:
            rows_before = spark.read.schema(batch.schema).option("basePath", path).parquet(*[f"{path}/version={v:012d}/bucket={b}" for b, v in before.items()])
            rows = rows.unionByName(rows_before.select(*batch.columns, "bucket"))
        latest(rows, key, at, tie).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number:012d}")
        held.unpersist()
        expire(spark, path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _versions(spark: SparkSession, path: str):
    """(file system, [(version, bucket, folder)]) of the finished versions under a path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for version in fs.listStatus(root) if fs.exists(root) else []:
        folder, name = version.getPath(), version.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            for bucket in fs.listStatus(folder):
                if bucket.getPath().getName().startswith("bucket="):
                    found.append((int(name.split("=")[1]), int(bucket.getPath().getName().split("=")[1]), bucket.getPath()))
    return fs, found


def newest_buckets(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The last finished version (smaller than ``below``) of each bucket."""
    newest: dict[int, int] = {}
    for version, bucket, _ in _versions(spark, path)[1]:
        if below is None or version < below:
            newest[bucket] = max(version, newest.get(bucket, -1))
    return newest


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` finished versions of each bucket."""
    fs, found = _versions(spark, path)
    by: dict[int, list] = {}
    for version, bucket, folder in found:
        by.setdefault(bucket, []).append((version, folder))
    left: dict = {}
    for held in by.values():
        ordered = sorted(held, key=lambda x: x[0])
        for _, folder in ordered[:-keep]:
            fs.delete(folder, True)
        for place, (version, folder) in enumerate(ordered):
            gone, parent = left.get(version, (True, folder.getParent()))
            left[version] = (gone and place < len(ordered) - keep, parent)
    for gone, parent in left.values():  # a version that no bucket needs
        if gone:
            fs.delete(parent, True)


def current_view(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each key, from the last finished version of each bucket."""
    newest = newest_buckets(spark, path)
    if not newest:
        raise FileNotFoundError(path)
    return spark.read.option("basePath", path).parquet(*[f"{path}/version={v:012d}/bucket={b}" for b, v in sorted(newest.items())]).drop("version", "bucket")


class Refreshing:
    """A table that is read anew when it is older than ``seconds``; if that fails, the one before stays in use.

    For dimensions that a stream is joined to (call it in ``enrich``, which runs for
    every micro-batch) and for aggregates that pages show.
    """

    def __init__(self, read: Callable[[], DataFrame], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock = read, seconds, clock
        self.held: DataFrame | None = None
        self.since = 0.0
        self.failures = 0

    def __call__(self) -> DataFrame:
        if self.held is None or self.clock() - self.since >= self.seconds:
            try:
                fresh = self.read().persist()
                fresh.count()
            except Exception:
                self.failures += 1
                if self.held is None:
                    raise
            else:
                if self.held is not None:
                    self.held.unpersist()
                self.held = fresh
            self.since = self.clock()
        return self.held


def with_dimension(dimension: Refreshing, key: str) -> Callable[[DataFrame], DataFrame]:
    """An ``enrich`` for :func:`append_log`: the dimension joined to each batch, as fresh as it is then."""
    return lambda batch: batch.join(dimension(), key, "left")


def recrawl_feed(stale: DataFrame, path: str, day: str) -> int:
    """Write stale domains as ``domain, source`` files that the ingesting stream reads; a day's feed that is written again replaces itself.  Returns how many."""
    rows = stale.select("domain", F.lit("recrawl").alias("source"))
    rows.write.mode("overwrite").parquet(f"{path}/day={day}")
    return stale.sparkSession.read.parquet(f"{path}/day={day}").count()


class Progress(StreamingQueryListener):
    """The last micro-batches' figures: rows, rows a second, state, and what was observed."""

    def __init__(self, most: int = 100):
        self.batches: deque[dict] = deque(maxlen=most)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.runId), None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"name": p.name, "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = event.exception

    def health(self, inflow: float) -> str:
        """Drain against inflow over the batches held: keeping up, lagging or behind."""
        drain = [b["per_second"] for b in self.batches if b["rows"]]
        ratio = sum(drain) / len(drain) / inflow if drain and inflow else (1.0 if not inflow else 0.0)
        return "ok" if ratio >= 0.9 else "warning" if ratio >= 0.5 else "critical"


def poll_workers(lag: Column, most: int, least: int = 1, target: int = 10_000) -> Column:
    """Parallel readers that a backlog asks for: all of them far behind, a share of them nearer to the target, the least on it."""
    part = lambda n, d: F.lit(most * n // d)
    by_lag = F.floor(lag / 2000).cast("int") * least
    return F.when(lag > 500_000, most).when(lag > 100_000, F.least(F.lit(most), by_lag)).when(lag > 50_000, F.least(F.lit(most), part(3, 4))).when(lag > target, F.least(F.lit(most), part(1, 4))).otherwise(least)
