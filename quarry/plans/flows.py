"""Registered queries that run streams to the end of the driver's event table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, current
from ..streaming import jobs
from .adapters import EVENT_LOG, WIDE, event_log, table, wide
from .book import add

LOG_NOW, VIEW_NOW = "2024-01-20 12:00:00", "1998-06-01"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream of log rows, with a time zone's times as watermarks need them."""
    rows = table(spark, sf, "events")
    raw = jobs.files(spark, f"{sf}/event[s].parquet", rows.schema)  # a pattern, as the table may be one file
    return raw.select(F.col("user_id").alias("domain"), F.col("ts").cast("timestamp").alias("enriched_at"), F.col("event_type").alias("status"), F.col("value").alias("response_time"), F.col("props").alias("body"), "event_id")


add("stream_first_seen", lambda s, d: jobs.drained(jobs.first_of_key(_stream(s, d), "domain", "enriched_at")).select("domain"), "SELECT DISTINCT domain FROM log", EVENT_LOG)
add(
    "stream_unexpired",
    lambda s, d: jobs.drained(jobs.unexpired(_stream(s, d), "enriched_at", F.to_timestamp(F.lit(LOG_NOW)))).groupBy("domain").agg(F.count("*").alias("n")),
    f"SELECT domain, count(*) AS n FROM log WHERE enriched_at >= TIMESTAMP '{LOG_NOW}' - INTERVAL 24 HOUR GROUP BY domain",
    EVENT_LOG,
)
add(
    "stream_rates",
    lambda s, d: jobs.drained(jobs.rates(_stream(s, d), "enriched_at", "1 hour")).select(F.unix_seconds("start").alias("start_s"), "cnt"),
    "SELECT CAST(floor(epoch(enriched_at) / 3600) AS BIGINT) * 3600 AS start_s, count(*) AS cnt FROM log GROUP BY 1 HAVING start_s + 3600 <= (SELECT floor(epoch(max(enriched_at)) * 1000) / 1000 - 600 FROM log)",
    EVENT_LOG,
)
add(
    "stream_platforms",
    lambda s, d: jobs.drained(jobs.platforms(_stream(s, d).withColumn("n", F.get_json_object("body", "$.k").cast("int")), "domain", "enriched_at", "n", 0.1, 95), "update").groupBy("k").agg(F.max_by(F.struct("cert_count", "max_subdomains", "is_platform"), "batch").alias("r")).select("k", "r.cert_count", "r.max_subdomains", "r.is_platform"),
    """SELECT CAST(domain AS VARCHAR) AS k, n AS cert_count, w AS max_subdomains, age >= 3600 AND (n / greatest(age / 3600.0::DOUBLE, 0.01) >= 0.1 OR w >= 95) AS is_platform
    FROM (SELECT domain, count(*) AS n, max(coalesce(CAST(json_extract_string(body, '$.k') AS INTEGER), 0)) AS w, epoch(max(enriched_at)) - epoch(min(enriched_at)) AS age FROM log GROUP BY domain)""",
    EVENT_LOG,
)
_ACCEPTED = """accepted AS (SELECT domain, min(enriched_at) AS t FROM log GROUP BY domain UNION ALL
    SELECT a.domain, min(l.enriched_at) FROM accepted a JOIN log l ON l.domain = a.domain AND l.enriched_at >= a.t + INTERVAL 43200 SECOND GROUP BY a.domain, a.t)"""
add(
    "stream_throttle",
    lambda s, d: jobs.drained(jobs.throttled(_stream(s, d), "domain", "enriched_at", 43_200.0)).groupBy("k").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted")),
    f"WITH RECURSIVE {EVENT_LOG}, {_ACCEPTED} SELECT CAST(domain AS VARCHAR) AS k, n, a AS accepted FROM (SELECT domain, count(*) AS n FROM log GROUP BY domain) JOIN (SELECT domain, count(*) AS a FROM accepted GROUP BY domain) USING (domain)",
)
add(
    "stream_quota",
    lambda s, d: jobs.drained(jobs.quota(_stream(s, d), "domain", "enriched_at", 2, 86_400)).groupBy("k", "bucket").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed")),
    "SELECT CAST(domain AS VARCHAR) AS k, CAST(floor(epoch(enriched_at) / 86400) AS BIGINT) AS bucket, count(*) AS n, least(count(*), 2) AS allowed FROM log GROUP BY 1, 2",
    EVENT_LOG,
)


def _log_months(spark: SparkSession, sf: str) -> DataFrame:
    """The stream appended to a log with month folders, enriched by a dimension that is read for the batch; read back by month."""
    path = jobs.work_dir(spark)
    users = jobs.Refreshing(lambda: table(spark, sf, "customer").select(F.col("c_custkey").alias("domain"), F.col("c_mktsegment").alias("segment")), 3600)
    query = jobs.append_log(_stream(spark, sf), f"{path}/log", f"{path}/checkpoint", jobs.with_dimension(users, "domain"), None)
    query.awaitTermination()
    return spark.read.parquet(f"{path}/log").groupBy(F.col("enriched_month").cast("int").alias("enriched_month"), "segment").agg(F.count("*").alias("n"))


add("stream_log_months", _log_months, "SELECT CAST(strftime(enriched_at, '%Y%m') AS INTEGER) AS enriched_month, c_mktsegment AS segment, count(*) AS n FROM log LEFT JOIN customer ON domain = c_custkey GROUP BY 1, 2", EVENT_LOG)


def _current_view(spark: SparkSession, sf: str) -> DataFrame:
    path = jobs.work_dir(spark)
    jobs.keep_current(_stream(spark, sf), f"{path}/view", f"{path}/checkpoint", tie="event_id").awaitTermination()
    return jobs.current_view(spark, f"{path}/view").select("domain", "status", "event_id")


add("stream_current_view", _current_view, "SELECT domain, status, event_id FROM log QUALIFY row_number() OVER (PARTITION BY domain ORDER BY enriched_at DESC, event_id DESC) = 1", EVENT_LOG)


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    """Stale domains written as a feed, twice on the same day, and read back."""
    path = jobs.work_dir(spark)
    stale = catalog.stale_domains(wide(spark, sf, apps=False), F.to_timestamp_ntz(F.lit(f"{VIEW_NOW} 00:00:00")), 700, 1400)
    for _ in range(2):
        jobs.recrawl_feed(stale, path, VIEW_NOW)
    return spark.read.parquet(path).select("domain", "source", F.col("day").cast("string").alias("day"))


add(
    "recrawl_feed",
    _feed,
    f"""SELECT domain, 'recrawl' AS source, '{VIEW_NOW}' AS day FROM wide WHERE http_status IS NOT NULL AND enriched_at < TIMESTAMP '{VIEW_NOW}' - CASE WHEN business_model IN ('Ecommerce', 'SaaS', 'Tool', 'Marketplace', 'Agency') THEN INTERVAL 700 DAY ELSE INTERVAL 1400 DAY END
    ORDER BY tranco_rank ASC NULLS LAST, domain LIMIT 5000""",
    WIDE,
)


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a listener saw a stream take in."""
    seen = jobs.Progress()
    spark.streams.addListener(seen)
    try:
        jobs.drained(_stream(spark, sf).select("domain"))
        until = time.monotonic() + 20
        while not seen.ended and time.monotonic() < until:  # events come a little later
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(seen)
    return spark.createDataFrame([(sum(b["rows"] for b in seen.batches), len(seen.ended), seen.health(1.0))], "rows long, ended int, health string")


add("stream_progress", _progress, "SELECT count(*) AS rows, CAST(1 AS INTEGER) AS ended, 'ok' AS health FROM log", EVENT_LOG)
add("refreshed_totals", lambda s, d: jobs.Refreshing(lambda: current.latest(event_log(s, d), tie="event_id").groupBy("status").agg(F.count("*").alias("n")), 60)(), "SELECT status, count(*) AS n FROM (SELECT status FROM log QUALIFY row_number() OVER (PARTITION BY domain ORDER BY enriched_at DESC, event_id DESC) = 1) GROUP BY status", EVENT_LOG)
