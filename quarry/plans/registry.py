"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains, html, text
from ..operators import catalog, current
from .adapters import EVENT_LOG, PAGE_ROWS, WIDE, event_log, page_rows, table, wide
from .book import ORACLE, QUERIES, add  # noqa: F401

#: The technology that stands for the platform in the driver's tables, two more, and times within their ranges.
PLATFORM, TECH, OTHER = "PROMO", "ECONOMY", "SMALL"
LOG_NOW, VIEW_NOW = "2024-01-20 12:00:00", "2000-01-01 00:00:00"


def _at(moment: str):
    return F.to_timestamp_ntz(F.lit(moment))


# --- the log and its current view -------------------------------------------------------------
_LATEST = "cur AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY domain ORDER BY enriched_at DESC, event_id DESC) = 1)"


def _current(spark, sf):
    return current.latest(event_log(spark, sf), tie="event_id")


add("key_top_statuses", lambda s, d: catalog.distribution(_current(s, d).where("response_time >= 5"), None, "status"), "SELECT status AS value, count(*) AS cnt FROM cur WHERE response_time >= 5 AND status <> '' GROUP BY status ORDER BY cnt DESC, value LIMIT 10", EVENT_LOG, _LATEST)
add("latest_per_key", lambda s, d: _current(s, d), "SELECT * FROM cur", EVENT_LOG, _LATEST)
add("latest_lookup", lambda s, d: _current(s, d).where("domain = 7"), "SELECT * FROM cur WHERE domain = 7", EVENT_LOG, _LATEST)
add("first_seen", lambda s, d: current.first_seen(event_log(s, d), "domain", "enriched_at", "event_id").select("event_id", "domain", "is_new"), "SELECT event_id, domain, row_number() OVER (PARTITION BY domain ORDER BY enriched_at, event_id) = 1 AS is_new FROM log", EVENT_LOG)
add(
    "platform_flags",
    lambda s, d: current.platform_flags(event_log(s, d), "domain", "enriched_at", "event_id", F.get_json_object("body", "$.k").cast("int"), 0.1, 95).select("event_id", "cert_count", "max_subdomains", "age_s", "is_platform"),
    """SELECT event_id, cert_count, max_subdomains, age_s, age_s >= 3600 AND (cert_count / greatest(age_s / 3600.0::DOUBLE, 0.01) >= 0.1 OR max_subdomains >= 95) AS is_platform FROM (
    SELECT event_id, count(*) OVER w AS cert_count, max(CAST(json_extract_string(body, '$.k') AS INTEGER)) OVER w AS max_subdomains,
    CAST(floor(epoch(enriched_at)) AS BIGINT) - min(CAST(floor(epoch(enriched_at)) AS BIGINT)) OVER w AS age_s FROM log WINDOW w AS (PARTITION BY domain ORDER BY enriched_at, event_id ROWS UNBOUNDED PRECEDING))""",
    EVENT_LOG,
)
add(
    "quota_decisions",
    lambda s, d: current.quota(event_log(s, d), "domain", "enriched_at", "event_id", F.when(F.col("domain") % 3 == 0, 1).when(F.col("domain") % 3 == 1, 2).otherwise(3), 86_400).select("event_id", "domain", "bucket", "allowed"),
    "SELECT event_id, domain, b AS bucket, row_number() OVER (PARTITION BY domain, b ORDER BY enriched_at, event_id) <= CASE domain % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS allowed FROM (SELECT *, CAST(floor(floor(epoch(enriched_at)) / 86400) AS BIGINT) AS b FROM log)",
    EVENT_LOG,
)
add("batches", lambda s, d: current.batches(event_log(s, d), "event_id", 1000).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")), "SELECT b AS batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS b FROM log) GROUP BY b", EVENT_LOG)
add(
    "rate_last_hour",
    lambda s, d: catalog.rate(event_log(s, d), _at(LOG_NOW), 3600),
    f"SELECT count(*) AS cnt, floor(count(*) / 3600.0::DOUBLE * 10 + 0.5) / 10 AS per_second FROM log WHERE enriched_at > TIMESTAMP '{LOG_NOW}' - INTERVAL 3600 SECOND AND enriched_at <= TIMESTAMP '{LOG_NOW}'",
    EVENT_LOG,
)
add(
    "rate_per_window",
    lambda s, d: event_log(s, d).groupBy(F.window(F.col("enriched_at").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("cnt")).select(F.unix_seconds("w.start").alias("start_s"), "cnt"),
    "SELECT CAST(floor(epoch(enriched_at) / 3600) AS BIGINT) * 3600 AS start_s, count(*) AS cnt FROM log GROUP BY 1",
    EVENT_LOG,
)
add(
    "latency_buckets",
    lambda s, d: event_log(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("response_time") < 20).alias("fast"), F.count_if((F.col("response_time") >= 20) & (F.col("response_time") < 100)).alias("medium"), F.count_if(F.col("response_time") >= 100).alias("slow")),
    "SELECT count(*) AS n, count(*) FILTER (response_time < 20) AS fast, count(*) FILTER (response_time >= 20 AND response_time < 100) AS medium, count(*) FILTER (response_time >= 100) AS slow FROM log",
    EVENT_LOG,
)


def _percentiles(spark, sf):
    """The element at ``floor(n * p / 100)`` of the last 1,000 samples of each status, ordered."""
    from pyspark.sql import Window

    recent = event_log(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("enriched_at"), F.desc("event_id")))).where("n <= 1000")
    a = F.sort_array(F.collect_list("response_time"))
    at = lambda p: F.col("a")[F.floor(F.size("a") * p / 100).cast("int")].alias(f"p{p}")
    return recent.groupBy("status").agg(a.alias("a")).select("status", at(50), at(95), at(99))


add(
    "latency_percentiles",
    _percentiles,
    """SELECT status, a[CAST(floor(len(a) * 50 / 100) AS INTEGER) + 1] AS p50, a[CAST(floor(len(a) * 95 / 100) AS INTEGER) + 1] AS p95, a[CAST(floor(len(a) * 99 / 100) AS INTEGER) + 1] AS p99 FROM (
    SELECT status, list(response_time ORDER BY response_time) AS a FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY status ORDER BY enriched_at DESC, event_id DESC) <= 1000) GROUP BY status)""",
    EVENT_LOG,
)
add(
    "error_taxonomy",
    lambda s, d: event_log(s, d).where("status = 'error'").select(F.when(F.contains("body", F.lit("1")), "one").when(F.contains("body", F.lit("2")), "two").otherwise("other").alias("kind"), "response_time").groupBy("kind").agg(F.count("*").alias("n"), F.max("response_time").alias("worst")),
    "SELECT CASE WHEN contains(body, '1') THEN 'one' WHEN contains(body, '2') THEN 'two' ELSE 'other' END AS kind, count(*) AS n, max(response_time) AS worst FROM log WHERE status = 'error' GROUP BY 1",
    EVENT_LOG,
)

# --- the current view, wide -------------------------------------------------------------------
_HAS = f"contains(http_tech, '{TECH}')"
_SHOP = f"contains(http_tech, '{PLATFORM}')"
_RANK = "ORDER BY tranco_rank ASC NULLS LAST, domain"
_BRIEF = "domain, http_title, http_tech, tranco_rank, inferred_country"
FULL = ["domain", "http_title", "http_tech", "http_apps", "http_language", "http_status", "http_response_time", "tranco_rank", "majestic_rank", "business_model", "industry", "rdap_registrar", "bgp_asn_org", "inferred_country"]
narrow = lambda s, d: wide(s, d, apps=False)

add("store_count", lambda s, d: catalog.store_count(narrow(s, d), PLATFORM), f"SELECT count(*) AS cnt FROM wide WHERE {_SHOP}", WIDE)
add("tech_count", lambda s, d: catalog.store_count(narrow(s, d), TECH), f"SELECT count(*) AS cnt FROM wide WHERE {_HAS}", WIDE)
add("tech_count_ci", lambda s, d: catalog.store_count(narrow(s, d), "eConomy", True), "SELECT count(*) AS cnt FROM wide WHERE contains(lower(http_tech), 'economy')", WIDE)
add("sample_stores", lambda s, d: catalog.sample_stores(narrow(s, d), PLATFORM), f"SELECT {_BRIEF} FROM wide WHERE {_SHOP} AND http_title <> '' {_RANK} LIMIT 6", WIDE)
add("recent", lambda s, d: catalog.recent_stores(narrow(s, d), PLATFORM), f"SELECT enriched_at, {_BRIEF} FROM wide WHERE {_SHOP} AND http_title <> '' ORDER BY enriched_at DESC, domain LIMIT 20", WIDE)
add("stores_by_tech", lambda s, d: catalog.sample_stores(narrow(s, d), TECH, 100), f"SELECT {_BRIEF} FROM wide WHERE {_HAS} AND http_title <> '' {_RANK} LIMIT 100", WIDE)
add("stores_by_tech_ci", lambda s, d: catalog.sample_stores(narrow(s, d), "economy", 100, fold=True), f"SELECT {_BRIEF} FROM wide WHERE contains(lower(http_tech), 'economy') AND http_title <> '' {_RANK} LIMIT 100", WIDE)
add("stores_by_tech_full", lambda s, d: catalog.sample_stores(wide(s, d), TECH, 100, FULL), f"SELECT {', '.join(FULL)} FROM wide WHERE {_HAS} AND http_title <> '' {_RANK} LIMIT 100", WIDE)
add("stores_by_tech_full_ci", lambda s, d: catalog.sample_stores(wide(s, d), "ECONOMY", 100, FULL, True), f"SELECT {', '.join(FULL)} FROM wide WHERE contains(lower(http_tech), 'economy') AND http_title <> '' {_RANK} LIMIT 100", WIDE)
add("tech_stats", lambda s, d: catalog.tech_stats(narrow(s, d), TECH), f"SELECT count(*) AS total, avg(http_response_time) AS avg_response, count(*) FILTER (http_status = 200) AS ok, count(*) FILTER (tranco_rank <= 100000) AS top_100k FROM wide WHERE {_HAS}", WIDE)
for _name, _column in (("language", "http_language"), ("hosting", "bgp_asn_org"), ("registrar", "rdap_registrar")):
    add(f"dist_{_name}", lambda s, d, c=_column: catalog.distribution(narrow(s, d), TECH, c), f"SELECT {_column} AS value, count(*) AS cnt FROM wide WHERE {_HAS} AND {_column} <> '' GROUP BY 1 ORDER BY cnt DESC, value LIMIT 10", WIDE)
add("dist_country", lambda s, d: catalog.distribution(narrow(s, d), TECH, domains.country()), f"SELECT coalesce(nullif(inferred_country, ''), 'US') AS value, count(*) AS cnt FROM wide WHERE {_HAS} GROUP BY 1 ORDER BY cnt DESC, value LIMIT 10", WIDE)
_PARTS = "SELECT unnest(string_split(http_tech, '|')) AS tech FROM wide"
add("tech_co_occurring", lambda s, d: catalog.co_occurring(narrow(s, d), TECH), f"SELECT tech, count(*) AS cnt FROM ({_PARTS} WHERE {_HAS}) WHERE tech <> '' AND tech <> '{TECH}' GROUP BY tech HAVING count(*) >= 2 ORDER BY cnt DESC, tech LIMIT 20", WIDE)
add("tech_directory", lambda s, d: catalog.directory(narrow(s, d)), f"SELECT tech, count(*) AS cnt FROM ({_PARTS}) WHERE tech <> '' GROUP BY tech HAVING count(*) >= 5 ORDER BY cnt DESC, tech LIMIT 500", WIDE)
add("all_tech_slugs", lambda s, d: catalog.directory(narrow(s, d)).select(text.slug("tech").alias("slug")), f"SELECT lower(tech) AS slug FROM ({_PARTS}) WHERE tech <> '' GROUP BY tech HAVING count(*) >= 5 ORDER BY count(*) DESC, tech LIMIT 500", WIDE)
add("country_directory", lambda s, d: catalog.distribution(narrow(s, d), PLATFORM, domains.country(), None), f"SELECT inferred_country AS value, count(*) AS cnt FROM wide WHERE {_SHOP} GROUP BY 1", WIDE)
add("compare_techs", lambda s, d: catalog.compare(narrow(s, d), TECH, OTHER), f"SELECT count(*) FILTER ({_HAS}) AS count_a, count(*) FILTER (contains(http_tech, '{OTHER}')) AS count_b, count(*) FILTER ({_HAS} AND contains(http_tech, '{OTHER}')) AS count_both FROM wide", WIDE)
add(
    "compare_countries",
    lambda s, d: catalog.compare_countries(narrow(s, d), TECH, OTHER),
    f"SELECT tech, inferred_country AS value, count(*) AS cnt, CAST(row_number() OVER (PARTITION BY tech ORDER BY count(*) DESC, inferred_country) AS INTEGER) AS place FROM (SELECT '{TECH}' AS tech, inferred_country FROM wide WHERE {_HAS} UNION ALL SELECT '{OTHER}', inferred_country FROM wide WHERE contains(http_tech, '{OTHER}')) GROUP BY 1, 2 QUALIFY place <= 10",
    WIDE,
)
_TOP = "SELECT domain, http_title, tranco_rank, inferred_country FROM wide WHERE"
add("top_by_country", lambda s, d: catalog.top_stores(narrow(s, d), None, "NATION_3", platform=PLATFORM), f"{_TOP} {_SHOP} AND inferred_country = 'NATION_3' {_RANK} LIMIT 50", WIDE)
add("top_using_tech", lambda s, d: catalog.top_stores(narrow(s, d), TECH, platform=PLATFORM), f"{_TOP} {_SHOP} AND {_HAS} {_RANK} LIMIT 50", WIDE)
add("top_tech_in_country", lambda s, d: catalog.top_stores(narrow(s, d), TECH, "NATION_3", platform=PLATFORM), f"{_TOP} {_SHOP} AND {_HAS} AND inferred_country = 'NATION_3' {_RANK} LIMIT 50", WIDE)
add("all_store_domains", lambda s, d: catalog.ranked(catalog.using(narrow(s, d), PLATFORM), 49_000).select("domain"), f"SELECT domain FROM wide WHERE {_SHOP} {_RANK} LIMIT 49000", WIDE)
add(
    "stale_keys",
    lambda s, d: catalog.stale_domains(narrow(s, d), _at(VIEW_NOW), 700, 1400),
    f"SELECT domain FROM wide WHERE http_status IS NOT NULL AND enriched_at < TIMESTAMP '{VIEW_NOW}' - CASE WHEN business_model IN ('Ecommerce', 'SaaS', 'Tool', 'Marketplace', 'Agency') THEN INTERVAL 700 DAY ELSE INTERVAL 1400 DAY END {_RANK} LIMIT 5000",
    WIDE,
)
FILTERS = {"tech": "economy, small", "shopify_app": "brand#1", "business_model": f"SaaS,{PLATFORM}", "industry": "Fashion,Finance", "domain": "1", "language": "", "unknown": "x"}
_WHERE = f"contains(lower(http_tech), 'economy') AND contains(lower(http_tech), 'small') AND contains(lower(http_apps), 'brand#1') AND (business_model = 'SaaS' OR contains(lower(http_tech), '{PLATFORM.lower()}')) AND industry IN ('Fashion', 'Finance') AND contains(domain, '1')"
_LIST = "domain, http_title, http_tech, http_apps, business_model, industry, estimated_revenue, estimated_employees, http_language, enriched_at, tranco_rank, majestic_rank, http_response_time, inferred_country"
add("explorer_list", lambda s, d: catalog.explore(wide(s, d), FILTERS, platform=PLATFORM), f"SELECT {_LIST} FROM wide WHERE {_WHERE} {_RANK} LIMIT 25", WIDE)
add("explorer_page2", lambda s, d: catalog.explore(wide(s, d), {"tech": "economy", "country": "NATION_3, NATION_4", "revenue": "<$1M"}, 2, 15, platform=PLATFORM), f"SELECT {_LIST} FROM wide WHERE contains(lower(http_tech), 'economy') AND inferred_country IN ('NATION_3', 'NATION_4') AND estimated_revenue = '<$1M' {_RANK} LIMIT 15 OFFSET 15", WIDE)
add("explorer_count", lambda s, d: catalog.explore_count(wide(s, d), FILTERS, platform=PLATFORM), f"SELECT count(*) AS cnt FROM wide WHERE {_WHERE}", WIDE)
add("explorer_fresh", lambda s, d: catalog.explore_count(narrow(s, d), {"freshness": "30d"}, _at(VIEW_NOW)), f"SELECT count(*) AS cnt FROM wide WHERE enriched_at >= TIMESTAMP '{VIEW_NOW}' - INTERVAL 30 DAY", WIDE)
add("detail", lambda s, d: catalog.detail(wide(s, d), "10", tuple(FULL)), f"SELECT {', '.join(FULL)} FROM wide WHERE domain = '10'", WIDE)
add("export_rows", lambda s, d: catalog.export(wide(s, d), {"tech": "promo"}, 500, platform=PLATFORM, columns=tuple(FULL)), f"SELECT {', '.join(FULL)} FROM wide WHERE contains(lower(http_tech), 'promo') {_RANK} LIMIT 500", WIDE)
add("distinct_languages", lambda s, d: catalog.distinct_values(narrow(s, d), "http_language", "low"), "SELECT DISTINCT http_language AS value FROM wide WHERE contains(lower(http_language), 'low') ORDER BY 1 LIMIT 50", WIDE)
add("distinct_countries", lambda s, d: catalog.distinct_values(narrow(s, d), domains.country(), "nation_1"), "SELECT DISTINCT inferred_country AS value FROM wide WHERE contains(lower(inferred_country), 'nation_1') ORDER BY 1 LIMIT 50", WIDE)
add("distinct_techs", lambda s, d: catalog.distinct_parts(narrow(s, d), "http_tech", "m"), f"SELECT DISTINCT tech AS value FROM ({_PARTS}) WHERE contains(lower(tech), 'm') ORDER BY 1 LIMIT 50", WIDE)
add("distinct_apps", lambda s, d: catalog.distinct_parts(wide(s, d), "http_apps", "#1", 50, PLATFORM), f"SELECT DISTINCT app AS value FROM (SELECT unnest(string_split(http_apps, '|')) AS app FROM wide WHERE {_SHOP}) WHERE contains(app, '#1') ORDER BY 1 LIMIT 50", WIDE)
add("tech_suggest", lambda s, d: catalog.suggest(narrow(s, d), "m"), f"SELECT tech, cnt FROM (SELECT tech, count(*) AS cnt FROM ({_PARTS}) WHERE tech <> '' GROUP BY tech HAVING count(*) >= 5) WHERE contains(lower(tech), 'm') ORDER BY starts_with(lower(tech), 'm') DESC, cnt DESC, tech LIMIT 10", WIDE)
add("landing_totals", lambda s, d: catalog.landing(wide(s, d), PLATFORM), f"SELECT (SELECT count(*) FROM wide WHERE {_SHOP}) AS stores, (SELECT count(*) FROM wide) AS total, (SELECT count(DISTINCT tech) FROM ({_PARTS}) WHERE tech <> '') AS n_tech, (SELECT count(DISTINCT app) FROM (SELECT unnest(string_split(http_apps, '|')) AS app FROM wide) WHERE app <> '') AS n_apps", WIDE)
add(
    "sitemap",
    lambda s, d: catalog.sitemap(narrow(s, d), PLATFORM),
    f"""SELECT 'https://example.com/store/' || domain AS loc FROM (SELECT domain FROM wide WHERE {_SHOP} {_RANK} LIMIT 10000)
    UNION ALL SELECT 'https://example.com' || p || lower(tech) FROM (SELECT tech FROM ({_PARTS}) WHERE tech <> '' GROUP BY tech HAVING count(*) >= 5), (VALUES ('/tech/'), ('/top/stores-using-')) AS v(p)
    UNION ALL SELECT DISTINCT 'https://example.com/top/stores-' || lower(inferred_country) FROM wide WHERE {_SHOP}
    UNION ALL SELECT 'https://example.com' || p FROM (VALUES ('/'), ('/top'), ('/tech'), ('/compare')) AS v(p)""",
    WIDE,
)

# --- pages ------------------------------------------------------------------------------------
_TRIM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
add("html_title", lambda s, d: page_rows(s, d).select("page_id", html.title("html").alias("title")), "SELECT page_id, left(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]{1,500})</title>', 1)), 200) AS title FROM page_rows", PAGE_ROWS)
add("html_h1", lambda s, d: page_rows(s, d).select("page_id", html.h1("html").alias("h1")), "SELECT page_id, left(" + _TRIM.format("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')") + ", 200) AS h1 FROM page_rows", PAGE_ROWS)
add("html_nav", lambda s, d: page_rows(s, d).select("page_id", html.nav_text("html").alias("nav")), "SELECT page_id, left(" + _TRIM.format("array_to_string(regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?is)<a[^>]*>([^<]{1,100})</a>', 1), ' ')") + ", 300) AS nav FROM page_rows", PAGE_ROWS)
add("html_text", lambda s, d: page_rows(s, d).select("page_id", html.visible_text("html").alias("body")), "SELECT page_id, left(" + _TRIM.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g')") + ", 500) AS body FROM page_rows", PAGE_ROWS)
add("html_lang", lambda s, d: page_rows(s, d).groupBy("http_language").agg(F.count("*").alias("n")), "SELECT http_language, count(*) AS n FROM page_rows GROUP BY 1", PAGE_ROWS)
add(
    "html_hrefs",
    lambda s, d: page_rows(s, d).select("page_id", text.joined(html.page_paths("html", "domain", None, [["/the", "/to"], ["/and"]])).alias("paths")),
    """SELECT page_id, coalesce(string_agg(p, '|' ORDER BY r, i), '') AS paths FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY r, i) AS n FROM (
    SELECT page_id, p, min(i) AS i, CASE WHEN p IN ('/the', '/to') THEN 0 WHEN p = '/and' THEN 1 ELSE 2 END AS r FROM (
    SELECT page_id, regexp_replace(regexp_replace(h, '[?#].*$', ''), '/+$', '') AS p, i FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(lower(html), '(?s)href=["'']([^"'']+)["'']', 1) AS l FROM page_rows)))
    WHERE p <> '' GROUP BY page_id, p)) WHERE n <= 10 GROUP BY page_id""",
    PAGE_ROWS,
)
_LABELS = "string_split(regexp_replace(domain, '^\\*\\.', ''), '.')"
add(
    "domain_parse",
    lambda s, d: page_rows(s, d).select("page_id", "domain", domains.parse_domain("domain").alias("p")).select("page_id", "domain", "p.base", "p.tld", "p.subdomain", "p.depth"),
    f"SELECT page_id, domain, array_to_string(l[-2:], '.') AS base, l[-1] AS tld, array_to_string(l[1:len(l) - 2], '|') AS subdomain, CAST(len(l) - 2 AS INTEGER) AS depth FROM (SELECT *, {_LABELS} AS l FROM page_rows)",
    PAGE_ROWS,
)
_ASSIGNED = "CASE page_id % 6 WHEN 0 THEN 'com' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'fr' WHEN 3 THEN 'io' WHEN 4 THEN 'com.br' ELSE 'org' END"
_tld = lambda: F.element_at(F.array(*map(F.lit, ["com", "co.uk", "fr", "io", "com.br", "org"])), (F.col("page_id") % 6 + 1).cast("int"))
_HOSTED = "CASE page_id % 4 WHEN 0 THEN 'DE' WHEN 1 THEN '' WHEN 2 THEN 'CA' ELSE 'NL' END"
_hosted = lambda: F.element_at(F.array(*map(F.lit, ["DE", "", "CA", "NL"])), (F.col("page_id") % 4 + 1).cast("int"))
_BY_SUFFIX = f"CASE {_ASSIGNED} WHEN 'co.uk' THEN 'GB' WHEN 'fr' THEN 'FR' WHEN 'com.br' THEN 'BR' END"
add(
    "country_infer",
    lambda s, d: page_rows(s, d).select("page_id", domains.infer_country(_tld(), "http_language", F.lit(""), _hosted()).alias("country")),
    f"SELECT page_id, coalesce({_BY_SUFFIX}, CASE http_language WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' WHEN 'es' THEN 'ES' END, CASE WHEN http_language = 'en' THEN 'US' END, nullif({_HOSTED}, ''), 'US') AS country FROM page_rows",
    PAGE_ROWS,
)
add(
    "country_expr",
    lambda s, d: page_rows(s, d).select("page_id", domains.country(F.lit(""), _tld(), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("http_language")), _hosted(), F.when(F.col("page_id") % 8 == 2, "23.227.38.1").otherwise("1.2.3.4")).alias("country")),
    f"SELECT page_id, coalesce({_BY_SUFFIX}, CASE WHEN page_id % 5 <> 0 THEN CASE http_language WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' WHEN 'es' THEN 'ES' WHEN 'en' THEN 'US' END END, CASE WHEN length({_HOSTED}) = 2 AND NOT ({_HOSTED} = 'CA' AND page_id % 8 = 2) THEN {_HOSTED} END, 'US') AS country FROM page_rows",
    PAGE_ROWS,
)
_SUFFIXES = ["example.com", "ther.example.org"]
add("suffix_theta_join", lambda s, d: page_rows(s, d).where(~domains.suffix_match("domain", _SUFFIXES)).select("page_id", "domain"), "SELECT page_id, domain FROM page_rows WHERE NOT (suffix(domain, 'example.com') OR suffix(domain, 'ther.example.org'))", PAGE_ROWS)

# --- enrichment, rules, models ----------------------------------------------------------------
from ..operators import classify as classifier  # noqa: E402
from ..operators import detect, enrich, revenue  # noqa: E402


def _people(spark, sf):
    """Customers as domains, with a rank table, a link table and a list of bad ones made from their keys."""
    base = table(spark, sf, "customer").select(F.concat(F.lit("www.d"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"), "c_custkey", "c_nationkey")
    name = F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain")
    ranks = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(name, F.floor("c_acctbal").cast("int").alias("tranco_rank"))
    links = table(spark, sf, "customer").where("c_custkey % 5 = 0").select(name, (F.col("c_custkey") + 1).cast("int").alias("majestic_rank"), (F.col("c_nationkey") * 100).cast("int").alias("majestic_ref_subnets"))
    bad = table(spark, sf, "customer").where("c_custkey % 7 = 0").select(name, F.element_at(F.array(F.lit("malware"), F.lit("phishing"), F.lit("disposable")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("kind"))
    return base, ranks, links, bad


add(
    "reputation_joins",
    lambda s, d: enrich.reputation(*_people(s, d)).select("domain", "tranco_rank", "majestic_rank", "majestic_ref_subnets", "is_malware", "is_phishing", "is_disposable_email"),
    """SELECT 'www.d' || c_custkey || '.com' AS domain, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal) AS INTEGER) END AS tranco_rank, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey + 1 AS INTEGER) END AS majestic_rank,
    CASE WHEN c_custkey % 5 = 0 THEN CAST(c_nationkey * 100 AS INTEGER) END AS majestic_ref_subnets, CASE WHEN c_custkey % 21 = 0 THEN 'true' ELSE '' END AS is_malware,
    CASE WHEN c_custkey % 7 = 0 AND c_custkey % 3 = 1 THEN 'true' ELSE '' END AS is_phishing, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 3 = 2 THEN 'true' ELSE '' END AS is_disposable_email FROM customer""",
)
add(
    "enrich_left_joins",
    lambda s, d: enrich.by_domain(
        table(s, d, "orders").select(F.col("o_orderkey").alias("domain"), "o_custkey"),
        table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("domain")).agg(F.count("*").alias("records"), F.max("l_shipdate").alias("last_seen")),
        table(s, d, "events").groupBy(F.col("user_id").alias("domain")).agg(F.count("*").alias("hits")),
    ).select("domain", F.coalesce("records", F.lit(0)).alias("records"), "last_seen", F.coalesce("hits", F.lit(0)).alias("hits")),
    """SELECT o_orderkey AS domain, coalesce(records, 0) AS records, last_seen, coalesce(hits, 0) AS hits FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS records, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey LEFT JOIN (SELECT user_id, count(*) AS hits FROM events GROUP BY 1) ON o_orderkey = user_id""",
)
add(
    "network_by_address",
    lambda s, d: enrich.by_address(
        table(s, d, "orders").select(F.col("o_orderkey").alias("domain"), "o_custkey"), table(s, d, "customer").select(F.concat(F.lit("10."), F.col("c_custkey").cast("string")).alias("bgp_ip"), F.col("c_mktsegment").alias("bgp_asn_org")), F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("10."), F.col("o_custkey").cast("string"))).otherwise("")
    ).select("domain", "bgp_ip", "bgp_asn_org"),
    "SELECT o_orderkey AS domain, ip AS bgp_ip, c_mktsegment AS bgp_asn_org FROM (SELECT *, CASE WHEN o_custkey % 4 <> 0 THEN '10.' || o_custkey ELSE '' END AS ip FROM orders) LEFT JOIN customer ON ip = '10.' || c_custkey",
)
add("blocklist_anti", lambda s, d: enrich.without(table(s, d, "supplier").select(F.col("s_suppkey").alias("domain"), "s_name"), table(s, d, "customer").where("c_acctbal < 0 or c_custkey % 2 = 0").select(F.col("c_custkey").alias("domain"))), "SELECT s_suppkey AS domain, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey % 2 = 0)")
add("rank_join_nulls_last", lambda s, d: catalog.ranked(enrich.reputation(*_people(s, d)), 100).select("domain", "tranco_rank"), "SELECT 'www.d' || c_custkey || '.com' AS domain, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal) AS INTEGER) END AS tranco_rank FROM customer ORDER BY tranco_rank ASC NULLS LAST, domain LIMIT 100")
_GATE = ["com", "org"]
add(
    "crawl_candidates",
    lambda s, d: enrich.candidates(page_rows(s, d).select("page_id", "domain", F.when(F.col("page_id") % 9 != 0, "1.2.3.4").otherwise("").alias("dns_a"), F.when(F.col("page_id") % 4 != 0, "10:mx").otherwise("").alias("dns_mx"), F.when(F.col("page_id") % 5 != 0, "v=spf1 -all").otherwise("x").alias("dns_txt")), registries=["therin.example.net"], gate=_GATE).select("page_id", "domain"),
    "SELECT page_id, domain FROM page_rows WHERE page_id % 9 <> 0 AND page_id % 4 <> 0 AND page_id % 5 <> 0 AND domain <> 'therin.example.net' AND (suffix(domain, '.com') OR suffix(domain, '.org')) AND length(split_part(domain, '.', 1)) >= 4 AND NOT regexp_matches(split_part(domain, '.', 1), '[0-9][0-9]') AND length(domain) - length(replace(domain, '-', '')) < 2",
    PAGE_ROWS,
)
add("stage_funnel", lambda s, d: enrich.funnel(page_rows(s, d), {"com": F.endswith("domain", F.lit(".com")), "english": F.col("http_language") == "en", "long": F.length("html") > 3000}), "SELECT count(*) AS input, count(*) FILTER (suffix(domain, '.com')) AS com, count(*) FILTER (http_language = 'en') AS english, count(*) FILTER (length(html) > 3000) AS long FROM page_rows", PAGE_ROWS)
PAGE_RULES = [("Tracker", [["track(0)"], ["track(1"]]), ("Advert", [['class="ad"']]), ("French", [['lang="fr"', "<nav>"]]), ("Secure", [["https://"]]), ("Absent", [["no such text"]])]
_RULED = " || ".join(f"CASE WHEN {c} THEN '|{n}' ELSE '' END" for n, c in (("Tracker", "(contains(h, 'track(0)') OR contains(h, 'track(1'))"), ("Advert", "contains(h, 'class=\"ad\"')"), ("French", "(contains(h, 'lang=\"fr\"') AND contains(h, '<nav>'))"), ("Secure", "contains(h, 'https://')")))
add("rule_detect", lambda s, d: page_rows(s, d).select("page_id", F.array_join(detect.matches(F.lower("html"), PAGE_RULES), "|").alias("tech")), f"SELECT page_id, substr({_RULED}, 2) AS tech FROM (SELECT page_id, lower(html) AS h FROM page_rows)", PAGE_ROWS)
WORD_RULES = [("the ", "english", 3), ("which", "english", 1), (" der ", "german", 2), ("und ", "german", 2), (" les ", "french", 4)]
add(
    "rule_score",
    lambda s, d: table(s, d, "documents").select("doc_id", detect.score(F.lower("text"), WORD_RULES).alias("m")).select("doc_id", *[F.col("m")[k].alias(k) for k in ("english", "french", "german")]),
    "SELECT doc_id, " + ", ".join(f"CAST({' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{p}{chr(39)}) THEN {n} ELSE 0 END' for p, t, n in WORD_RULES if t == k)} AS INTEGER) AS {k}" for k in ("english", "french", "german")) + " FROM documents",
)


def _site_signals(spark, sf):
    """Conversations' turns as page texts with a few signals beside them."""
    return table(spark, sf, "pages").select(
        "page_id", html.title("html").alias("http_title"), html.h1("html").alias("h1"), html.visible_text("html").alias("body_text"), html.nav_text("html").alias("nav_links"),
        F.when(F.col("page_id") % 3 == 0, "Shopify|React").when(F.col("page_id") % 3 == 1, "Substack").otherwise("").alias("http_tech"), F.when(F.col("page_id") % 4 == 0, "Klaviyo|Loox").otherwise("").alias("http_apps"),
        F.when(F.col("page_id") % 5 == 0, "Dentist").when(F.col("page_id") % 5 == 1, "ClothingStore").otherwise("").alias("http_schema_type"), F.when(F.col("page_id") % 7 == 0, "law").otherwise("com").alias("ctl_tld"),
    )


add(
    "business_class",
    lambda s, d: classifier.classify(_site_signals(s, d)).select("page_id", "business_model", "industry", "classification_confidence", "method"),
    """SELECT page_id, CASE WHEN sure THEN CASE WHEN best = 0 THEN '' WHEN best = co THEN 'Consulting' WHEN best = ec THEN 'Ecommerce' ELSE 'Newsletter' END ELSE '' END AS business_model,
    CASE WHEN sure THEN CASE WHEN ib = 0 THEN '' WHEN ib = fa THEN 'Fashion' WHEN ib = he THEN 'Healthcare' ELSE 'Legal' END ELSE '' END AS industry, CASE WHEN sure THEN conf ELSE 0.0 END AS classification_confidence,
    CASE WHEN sure THEN array_to_string(list_filter([CASE WHEN page_id % 3 < 2 OR page_id % 4 = 0 THEN 'tech' END, CASE WHEN page_id % 5 < 2 THEN 'schema' END, CASE WHEN page_id % 7 = 0 THEN 'tld' END], lambda x: x IS NOT NULL), '+') ELSE '' END AS method
    FROM (SELECT *, conf >= 0.55 AS sure FROM (SELECT *, floor(least(CASE WHEN best >= ib THEN best / greatest(ec + nl + co, 1)::DOUBLE ELSE ib / greatest(he + fa + le, 1)::DOUBLE END * 0.5 + least(greatest(best, ib) / 25.0::DOUBLE, 1.0) * 0.5, 0.99) * 100 + 0.5) / 100 AS conf FROM (
    SELECT *, greatest(ec, nl, co) AS best, greatest(he, fa, le) AS ib FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 12 ELSE 0 END + CASE WHEN page_id % 4 = 0 THEN 8 ELSE 0 END + CASE WHEN page_id % 5 = 1 THEN 9 ELSE 0 END AS ec,
    CASE WHEN page_id % 3 = 1 THEN 12 ELSE 0 END AS nl, CASE WHEN page_id % 5 = 0 THEN 8 ELSE 0 END AS co, CASE WHEN page_id % 5 = 0 THEN 10 ELSE 0 END AS he, CASE WHEN page_id % 5 = 1 THEN 10 ELSE 0 END AS fa, CASE WHEN page_id % 7 = 0 THEN 10 ELSE 0 END AS le FROM pages))))""",
)


_SCORES = [f"(o_orderkey * {k} % 17)" for k in (3, 5, 7, 11, 13)]
add(
    "softmax_brackets",
    lambda s, d: table(s, d, "orders").select("o_orderkey", revenue.softmax_top([F.expr(x).cast("double") for x in _SCORES]).alias("t")).select("o_orderkey", F.col("t.place").alias("place"), (F.floor(F.col("t.share") * 1e6 + 0.5) / 1e6).alias("share")),
    f"SELECT o_orderkey, CAST(list_position(s, b) - 1 AS INTEGER) AS place, floor(1.0 / list_sum(list_transform(s, lambda x: exp((x - b) / 2.0))) * 1e6 + 0.5) / 1e6 AS share FROM (SELECT o_orderkey, s, list_max(s) AS b FROM (SELECT o_orderkey, [{', '.join(f'{x}::DOUBLE' for x in _SCORES)}] AS s FROM orders))",
)
add(
    "embedding_argmax",
    lambda s, d: classifier.label_similarity(table(s, d, "embeddings"), classifier.centroids(table(s, d, "embeddings"))).select("vec_id", "best_label"),
    """SELECT vec_id, label AS best_label FROM (SELECT e.vec_id, c.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), c.v) DESC, c.label) AS n FROM embeddings e, (
    SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)) c) WHERE n = 1""",
)

# --- labels -----------------------------------------------------------------------------------
from ..functions import language  # noqa: E402
from ..operators import grades, queue  # noqa: E402

_LANGS = sorted(language.FUNCTION_WORDS)
_LISTS = ", ".join("[" + ", ".join(f"'{w}'" for w in language.FUNCTION_WORDS[k]) + "]" for k in _LANGS)
add(
    "language_by_words",
    lambda s, d: table(s, d, "documents").select("doc_id", language.by_words("text").alias("found")),
    f"""SELECT doc_id, CASE WHEN length(t) >= {language.LEAST} AND best > 0 AND best >= len(w) * 0.08 THEN {_LANGS}[list_position(c, best)] END AS found FROM (SELECT *, list_max(c) AS best FROM (
    SELECT doc_id, t, w, list_transform([{_LISTS}], lambda l: len(list_filter(w, lambda x: list_contains(l, x)))) AS c FROM (
    SELECT doc_id, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM documents)))""",
)
_AS_OF = "2002-01-01"
_DAYS = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{_AS_OF}')"
add(
    "domain_ages",
    lambda s, d: table(s, d, "orders").select("o_orderkey", grades.age_short("o_orderdate", F.lit(_AS_OF).cast("date")).alias("short"), grades.age_long("o_orderdate", F.lit(_AS_OF).cast("date")).alias("long")),
    f"""SELECT o_orderkey, CASE WHEN n < 30 THEN n || 'd' WHEN n < 365 THEN (n // 30) || 'm' ELSE (n // 365) || 'y' END AS short,
    CASE WHEN n < 30 THEN n || ' days' WHEN n < 365 THEN (n // 30) || ' months' WHEN n % 365 // 30 > 0 THEN (n // 365) || 'y ' || (n % 365 // 30) || 'm' ELSE (n // 365) || ' years' END AS long FROM (SELECT o_orderkey, {_DAYS} AS n FROM orders)""",
)
add(
    "freshness_labels",
    lambda s, d: event_log(s, d).where(F.col("enriched_at") <= _at(LOG_NOW)).select(grades.freshness("enriched_at", _at(LOG_NOW)).alias("label")).groupBy("label").agg(F.count("*").alias("n")),
    f"SELECT CASE WHEN h <= 24 THEN '24h' WHEN h <= 168 THEN '7d' WHEN h <= 720 THEN '30d' END AS label, count(*) AS n FROM (SELECT (epoch(TIMESTAMP '{LOG_NOW}') - floor(epoch(enriched_at))) / 3600.0 AS h FROM log WHERE enriched_at <= TIMESTAMP '{LOG_NOW}') GROUP BY 1",
    EVENT_LOG,
)


def _graded(spark, sf):
    """Orders with registration, mail and hosting columns made from their keys."""
    return wide(spark, sf).withColumns(
        {
            "dns_mx": F.when(F.col("tranco_rank") % 3 == 0, "10:aspmx.l.google.com").when(F.col("tranco_rank") % 3 == 1, "10:mail.ovh.net").otherwise(""),
            "rdap_domain_created_at": F.col("enriched_at").cast("string"), "ctl_subdomain_count": F.col("http_response_time"), "ctl_issuer": F.lit("R3"),
        }
    )


add(
    "section_badges",
    lambda s, d: _graded(s, d).select(grades.badges().alias("b")).select("b.*").groupBy("tech", "app", "dns", "network", "domain", "ssl", "rankings").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN t >= 8 THEN 'gold' WHEN t >= 4 THEN 'silver' WHEN t >= 1 THEN 'bronze' END AS tech, CASE WHEN a >= 5 THEN 'gold' WHEN a >= 2 THEN 'silver' WHEN a >= 1 THEN 'bronze' END AS app,
    CASE WHEN tranco_rank % 3 = 0 THEN 'gold' WHEN tranco_rank % 3 = 1 THEN 'silver' END AS dns, 'bronze' AS network, 'silver' AS domain,
    CASE WHEN http_response_time >= 20 THEN 'gold' WHEN http_response_time >= 5 THEN 'silver' ELSE 'bronze' END AS ssl,
    CASE WHEN r <= 100000 THEN 'gold' WHEN r <= 500000 THEN 'silver' WHEN r <= 2000000 THEN 'bronze' END AS rankings, count(*) AS n
    FROM (SELECT *, len(list_filter(string_split(http_tech, '|'), lambda x: x <> '')) AS t, len(list_filter(string_split(http_apps, '|'), lambda x: x <> '')) AS a, least(coalesce(tranco_rank, 999999999), coalesce(majestic_rank, 999999999)) AS r FROM wide) GROUP BY ALL""",
    WIDE,
)
add(
    "queue_accounting",
    lambda s, d: queue.replay(table(s, d, "events").select(F.pmod("user_id", F.lit(16)).alias("queue"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.when(F.col("event_type") == "purchase", "dequeue").when(F.col("event_type") == "error", "fail").otherwise("enqueue").alias("call"), F.col("event_id").alias("id"), F.lit(4).alias("n")).withColumn("t", F.col("us") / 1e6), 50, 3600.0, 86_400.0),
)

from . import answers, flows, inputs  # noqa: E402, F401 - they enter more queries
