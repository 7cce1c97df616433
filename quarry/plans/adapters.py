"""The driver's tables as the engine's relations, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import host
from ..functions.html import html_language


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the append-only log: a user is a domain."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("domain"), F.col("ts").alias("enriched_at"), F.col("event_type").alias("status"), F.col("value").alias("response_time"), F.col("props").alias("body"), "event_id"
    )


EVENT_LOG = "log AS (SELECT user_id AS domain, ts AS enriched_at, event_type AS status, value AS response_time, props AS body, event_id FROM events)"


def wide(spark: SparkSession, sf_dir: str, apps: bool = True) -> DataFrame:
    """``orders`` with customer, nation and the parts ordered, as the current view: an order is a domain.

    Multi-value columns come from one aggregation of line items; without
    ``apps`` it carries one column less.
    """
    t = lambda name: table(spark, sf_dir, name)
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", *(["p_brand"] if apps else []))
    lines = t("lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").groupBy("l_orderkey")
    joined = lambda c, name: F.array_join(F.array_sort(F.collect_set(c)), "|").alias(name)
    tech = lines.agg(joined("p_type", "http_tech"), *([joined("p_brand", "http_apps")] if apps else []))
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col(c), F.lit(len(names))) + 1).cast("int"))
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        t("orders")
        .join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(tech, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("domain"),
            F.col("o_orderdate").alias("enriched_at"),
            F.coalesce("http_tech", F.lit("")).alias("http_tech"),
            (F.coalesce("http_apps", F.lit("")) if apps else F.lit("")).alias("http_apps"),
            F.col("o_orderpriority").alias("http_language"),
            F.coalesce("c_name", F.lit("")).alias("http_title"),
            F.coalesce("n_name", F.lit("")).alias("inferred_country"),
            F.coalesce("c_mktsegment", F.lit("")).alias("rdap_registrar"),
            F.concat(F.lit("AS"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit(""))).alias("bgp_asn_org"),
            F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 301).cast("int").alias("http_status"),
            F.pmod("o_custkey", F.lit(1500)).cast("int").alias("http_response_time"),
            F.when(F.col("o_orderkey") % 3 != 0, F.floor("o_totalprice").cast("int")).alias("tranco_rank"),
            F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") * 10).cast("int")).alias("majestic_rank"),
            pick("o_orderkey", "Ecommerce", "SaaS", "Agency", "Blog", "").alias("business_model"),
            pick("o_custkey", "Fashion", "Finance", "Health", "").alias("industry"),
            pick("o_orderkey", "<$1M", "$1M-$10M", "$10M-$100M", "").alias("estimated_revenue"),
            pick("o_custkey", "1-10", "11-50", "51-200").alias("estimated_employees"),
            F.lit("").alias("ctl_tld"),
            F.lit("").alias("bgp_asn_country"),
            F.lit("").alias("bgp_ip"),
        )
    )


WIDE = """parts AS (SELECT l_orderkey, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS http_tech, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS http_apps
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
wide AS (SELECT CAST(o_orderkey AS VARCHAR) AS domain, o_orderdate AS enriched_at, coalesce(http_tech, '') AS http_tech, coalesce(http_apps, '') AS http_apps, o_orderpriority AS http_language,
  coalesce(c_name, '') AS http_title, coalesce(n_name, '') AS inferred_country, coalesce(c_mktsegment, '') AS rdap_registrar, 'AS' || coalesce(CAST(c_nationkey AS VARCHAR), '') AS bgp_asn_org,
  CAST(CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 301 END AS INTEGER) AS http_status, CAST(o_custkey % 1500 AS INTEGER) AS http_response_time,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS INTEGER) END AS tranco_rank, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey * 10 AS INTEGER) END AS majestic_rank,
  ['Ecommerce', 'SaaS', 'Agency', 'Blog', ''][o_orderkey % 5 + 1] AS business_model, ['Fashion', 'Finance', 'Health', ''][o_custkey % 4 + 1] AS industry,
  ['<$1M', '$1M-$10M', '$10M-$100M', ''][o_orderkey % 4 + 1] AS estimated_revenue, ['1-10', '11-50', '51-200'][o_custkey % 3 + 1] AS estimated_employees
  FROM orders LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey LEFT JOIN parts ON o_orderkey = l_orderkey)"""


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as fetched bodies: host, registrable part and language beside the HTML."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", host("url").alias("domain"), "html", html_language("html").alias("http_language"))


PAGE_ROWS = """page_rows AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS domain, html,
  regexp_extract(replace(lower(trim(regexp_extract(html, '(?is)<html[^>]*\\blang\\s*=\\s*["'']([^"'']+)["'']', 1))), '_', '-'), '^[^,;\\s]*') AS http_language FROM pages)"""
