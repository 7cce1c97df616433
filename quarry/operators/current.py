"""The append-only log and the view of the newest row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "domain", at: str = "enriched_at", tie: str | None = None) -> DataFrame:
    """The newest row of each key; equal times are settled by ``tie``, the greatest first.

    One shuffle on the key; where the log is bucketed by it, none.
    """
    order = [F.desc_nulls_last(at), *([F.desc_nulls_last(tie)] if tie else [])]
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def month(at: str | Column = "enriched_at") -> Column:
    """The log's partition value of a time."""
    return F.date_format(at, "yyyyMM").cast("int")


def since(log: DataFrame, low: Column, at: str = "enriched_at", partition: str | None = None) -> DataFrame:
    """Rows from ``low`` on.  With a month ``partition`` column the bound on it is spelt out, which prunes folders."""
    rows = log.where(F.col(at) >= low)
    return rows.where(F.col(partition) >= F.date_format(low, "yyyyMM").cast("int")) if partition else rows


def append(rows: DataFrame, path: str, key: str = "domain", at: str = "enriched_at") -> None:
    """Append to the log: a folder for each month, rows sorted by key and time, so that row groups can be skipped."""
    rows.withColumn("enriched_month", month(at)).repartition("enriched_month", key).sortWithinPartitions(key, at).write.mode("append").partitionBy("enriched_month").parquet(path)


def first_seen(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Every row with ``is_new``: the first of its key."""
    return log.withColumn("is_new", F.row_number().over(Window.partitionBy(key).orderBy(at, tie)) == 1)


def platform_flags(log: DataFrame, key: str, at: str, tie: str, subdomains: Column, per_hour: float = 20.0, many: int = 100, age: int = 3600) -> DataFrame:
    """Running ``cert_count, max_subdomains, age_s`` by key and ``is_platform``: old enough, and busy or wide."""
    window = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    return (
        log.withColumn("cert_count", F.count("*").over(window))
        .withColumn("max_subdomains", F.max(subdomains).over(window))
        .withColumn("age_s", seconds - F.min(seconds).over(window))
        .withColumn("is_platform", (F.col("age_s") >= age) & ((F.col("cert_count") / F.greatest(F.col("age_s") / 3600.0, F.lit(0.01)) >= per_hour) | (F.col("max_subdomains") >= many)))
    )


def quota(requests: DataFrame, user: str, at: str, tie: str, limit: Column, seconds: int = 60) -> DataFrame:
    """``allowed``: is the request among the first ``limit`` of its user's fixed interval?"""
    bucket = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds)
    return requests.withColumn("bucket", bucket).withColumn("allowed", F.row_number().over(Window.partitionBy(user, "bucket").orderBy(at, tie)) <= limit)


def batches(rows: DataFrame, order: str, size: int, cells: int | None = None) -> DataFrame:
    """``batch_id``: first in, first out, ``size`` rows a batch.

    The place in the order is counted by ranges of about equal size, whose
    number grows with the rows: those within a range are numbered in parallel,
    and only the ranges' counts are added up.
    """
    counted = rows.select(order).agg(F.count("*"), F.count(order)).first()
    if not counted[1]:
        return rows.withColumn("batch_id", F.lit(None).cast("long"))
    cells = cells or max(64, counted[0] // 1_000_000)
    bounds = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(20 * cells))).first()[0]
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col(order))) if cells <= 512 else _between(order, sorted(set(bounds)))
    cut = rows.withColumn("_cell", cell)
    before = cut.groupBy("_cell").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(order)) + F.coalesce("_before", F.lit(0))
    return cut.join(F.broadcast(before), "_cell").withColumn("batch_id", F.floor((place - 1) / size).cast("long")).drop("_cell", "_before")  # a row for each range


def _between(order: str, bounds: list) -> Column:
    """How many of many sorted bounds a value reaches: by halving, so that the work is that of the list's depth."""
    if len(bounds) <= 64:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order)))
    mid = len(bounds) // 2
    return F.when(F.col(order) < F.lit(bounds[mid]), _between(order, bounds[:mid])).otherwise(_between(order, bounds[mid:]) + mid)


def evict(state: DataFrame, most: int, batch: int, at: str, key: str) -> DataFrame:
    """State without its ``batch`` oldest keys once it holds ``most`` or more."""
    if state.limit(most).count() < most:
        return state
    oldest = state.orderBy(at, key).limit(batch).select(key)
    return state.join(oldest, key, "left_anti")


def throttle(requests: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """``k, at, accepted, wait_s``: a request passes if ``gap`` seconds have gone since the last that passed; refused ones don't move the clock.

    Each decision depends on the one before, so a key's requests are walked in
    order within its task.  They come sorted and pass through in batches: a task
    remembers one time, however many requests a key has.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    step = int(round(gap * 1e6))

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for part in parts:
            keys, us = part.column(0).to_pylist(), part.column(1).to_numpy()
            wait = np.zeros(len(us), np.int64)
            start = 0
            while start < len(us):
                end = start + 1
                while end < len(us) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != now or last is None:
                    now, last = keys[start], None
                at_ = start
                while at_ < end:
                    if last is not None:
                        free = start + int(np.searchsorted(us[start:end], last + step))
                        wait[at_:free] = last + step - us[at_:free]
                        at_ = max(at_, free)
                    if at_ < end:
                        last = int(us[at_])
                        at_ += 1
                start = end
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(wait)], names=["k", "us", "wait"])

    narrow = requests.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("us is not null")
    walked = narrow.repartition("k").sortWithinPartitions("k", "us").mapInArrow(walk, "k string, us long, wait long")
    return walked.select("k", F.timestamp_micros("us").alias("at"), (F.col("wait") == 0).alias("accepted"), F.when(F.col("wait") > 0, F.col("wait") / 1e6).alias("wait_s"))


def wait_stats(throttled: DataFrame) -> DataFrame:
    """One row over :func:`throttle`'s: keys, refused requests, and the sum, mean and greatest of what they had to wait."""
    return throttled.agg(
        F.count_distinct("k").alias("keys"), F.count("wait_s").alias("waits"), F.coalesce(F.sum("wait_s"), F.lit(0.0)).alias("wait_s"), F.coalesce(F.round(F.avg("wait_s"), 1), F.lit(0.0)).alias("avg_wait_s"), F.coalesce(F.max("wait_s"), F.lit(0.0)).alias("max_wait_s")
    )
