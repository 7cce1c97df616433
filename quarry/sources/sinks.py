"""Writers: exports, archives, retention and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_field


def csv_lines(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``line``: each row as a line of CSV; quoted where needed, null as empty."""
    return rows.select(F.concat_ws(",", *[csv_field(c) for c in columns or rows.columns]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def to_json(columns: list[str]) -> Column:
    """A JSON object of the columns; nulls are left out."""
    return F.to_json(F.struct(*columns))


def linked_data(kind: str, **parts: Column) -> Column:
    """A schema.org object as JSON: its context and type, then the parts; nulls and empty strings are left out."""
    text = lambda c: F.nullif(c, F.lit("")) if isinstance(c, Column) else c
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[text(c).alias(n) for n, c in parts.items()]))


def store_linked_data() -> Column:
    """A store as an organisation, over the row's columns."""
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.col("inferred_country").alias("addressCountry"))
    head = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), F.col("http_title").alias("name"), F.concat(F.lit("https://"), F.col("domain")).alias("url"), address.alias("address"),
        F.nullif(F.col("http_meta_description"), F.lit("")).alias("description"), F.left(F.col("rdap_domain_created_at").cast("string"), F.lit(10)).alias("foundingDate"), F.nullif(F.substring_index(F.col("http_emails"), "|", 1), F.lit("")).alias("email"),
    )
    return F.to_json(head)


def answer(data: Column | None = None, error: Column | None = None) -> Column:
    """The envelope of a JSON answer: ``ok`` with ``data``, or without but with ``error``."""
    return F.to_json(F.struct(F.lit(True).alias("ok"), data.alias("data")) if error is None else F.struct(F.lit(False).alias("ok"), error.alias("error")))


#: Kinds of failed requests, the first whose parts a reason holds; ``other_errors`` if none does.
ERROR_KINDS = [
    ("pool_timeouts", ["pool_timeout"]),
    ("dns_errors", ["nxdomain", "dns"]),
    ("connection_errors", ["econnrefused", "closed", "timeout"]),
    ("tls_errors", ["tls", "ssl", "handshake", "certificate"]),
]


def metrics(requests: DataFrame, elapsed_ms: str, reason: str, seconds: float) -> DataFrame:
    """One row of counts over requests (``reason`` is null for a good one): totals, speed, failures by kind, rate a second."""
    ms, why = F.col(elapsed_ms), F.col(reason)
    kind = F.coalesce(*[F.when(why.rlike("|".join(parts)), F.lit(name)) for name, parts in ERROR_KINDS], F.lit("other_errors"))
    good = why.isNull()
    counts = {
        "total": F.count("*"), "successful": F.count_if(good), "fast": F.count_if(good & (ms < 200)), "medium": F.count_if(good & (ms >= 200) & (ms < 1000)), "slow": F.count_if(good & (ms >= 1000)),
        **{name: F.count_if(~good & (kind == name)) for name in (*[n for n, _ in ERROR_KINDS], "other_errors")}, "rate": F.floor(F.count_if(good) / F.lit(float(seconds)) * 100 + 0.5) / 100,
    }
    return requests.agg(*[c.alias(n) for n, c in counts.items()])


def append_metrics(row: DataFrame, path: str, as_of: Column) -> None:
    """Append the row of :func:`metrics` to a folder of CSV lines, its time first."""
    row.select(as_of.alias("at"), *row.columns).coalesce(1).write.mode("append").csv(path)


def sitemap_xml(locations: DataFrame, column: str = "loc") -> DataFrame:
    """``xml``: an entry for each location, escaped."""
    text = F.col(column)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return locations.select(F.format_string("<url><loc>%s</loc></url>", text).alias("xml"))


def archive(ranks: DataFrame, path: str, rank: str, most: int = 1_000_000) -> None:
    """The best ranks as compressed CSV."""
    ranks.orderBy(rank).limit(most).write.mode("overwrite").option("compression", "gzip").csv(path, header=True)


def dated_archive(ranks: DataFrame, path: str, rank: str, day: str, keep_days: int = 30, most: int = 1_000_000) -> list[str]:
    """The day's archive as ``path/day=YYYY-MM-DD``; those older than ``keep_days`` go.  Returns the days that went."""
    from datetime import date, timedelta

    archive(ranks, f"{path}/day={day}", rank, most)
    oldest = (date.fromisoformat(day) - timedelta(days=keep_days)).isoformat()
    return _drop(ranks.sparkSession, path, "day=", lambda value: value < oldest)


def drop_months(spark: SparkSession, path: str, before: int) -> list[str]:
    """Delete a log's month folders before ``yyyymm``; returns those deleted."""
    return _drop(spark, path, "enriched_month=", lambda value: value.isdigit() and int(value) < before)


def _drop(spark: SparkSession, path: str, prefix: str, old: Callable[[str], bool]) -> list[str]:
    """Delete the folders ``prefix...`` under a path whose value is old."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(prefix) and old(name.removeprefix(prefix)):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def quota_limit(plan: Column) -> Column:
    """Rows a plan may export: fixed values by plan."""
    return F.when(plan == "free", 0).when(plan == "starter", 500).when(plan == "pro", 5000).otherwise(0)
