"""Registered queries over pages' answers, scores and texts, beyond the catalogue in ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains, format, html, language, text
from ..operators import catalog, classify, current, detect, dns_score, enrich, grades, revenue
from ..sources import sinks
from .adapters import EVENT_LOG, PAGE_ROWS, WIDE, event_log, page_rows, table, wide
from .book import add

LOG_NOW, VIEW_NOW = "2024-01-20 12:00:00", "1998-06-01"
_RANK = "ORDER BY tranco_rank ASC NULLS LAST, domain"


def _at(moment: str):
    return F.to_timestamp_ntz(F.lit(moment))


def _pick(column: str, values: list):
    """One of some values by a number's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


def _case(column: str, values: list[str]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


# --- pages of the site --------------------------------------------------------------------------
def _page_sql(has: str, stores: str) -> str:
    group = lambda block, value, where="true": f"SELECT '{block}' AS block, value AS label, CAST(cnt AS DOUBLE) AS number FROM (SELECT {value} AS value, count(*) AS cnt FROM named WHERE {has} AND {value} <> '' AND {where} GROUP BY 1 ORDER BY cnt DESC, value LIMIT 10)"
    return f"""SELECT 'stores' AS block, domain AS label, CAST(tranco_rank AS DOUBLE) AS number FROM (SELECT domain, tranco_rank FROM named WHERE {stores} AND http_title <> '' {_RANK} LIMIT 100)
    UNION ALL {group('countries', "coalesce(nullif(inferred_country, ''), 'US')")} UNION ALL {group('languages', 'http_language')} UNION ALL {group('hosting', 'bgp_asn_org')} UNION ALL {group('registrars', 'rdap_registrar')}
    UNION ALL SELECT 'together', tech, CAST(cnt AS DOUBLE) FROM (SELECT tech, count(*) AS cnt FROM (SELECT unnest(string_split(http_tech, '|')) AS tech FROM named WHERE {has}) WHERE tech <> '' AND tech <> 'Economy' GROUP BY tech HAVING count(*) >= 2 ORDER BY cnt DESC, tech LIMIT 20)
    UNION ALL SELECT 'figures', m.label, m.number FROM (SELECT unnest([{{'label': 'total', 'number': count(*)::DOUBLE}}, {{'label': 'avg_response', 'number': avg(http_response_time)}}, {{'label': 'ok', 'number': (count(*) FILTER (http_status = 200))::DOUBLE}}, {{'label': 'top_100k', 'number': (count(*) FILTER (tranco_rank <= 100000))::DOUBLE}}]) AS m FROM named WHERE {has})"""


_NAMED = "named AS (SELECT * REPLACE (replace(http_tech, 'ECONOMY', 'Economy') AS http_tech) FROM wide)"
add("tech_page", lambda s, d: catalog.tech_page(wide(s, d, apps=False).withColumn("http_tech", F.replace("http_tech", F.lit("ECONOMY"), F.lit("Economy"))), "economy"), _page_sql("contains(http_tech, 'Economy')", "contains(http_tech, 'Economy')"), WIDE, _NAMED)
add("tech_page_folded", lambda s, d: catalog.tech_page(wide(s, d, apps=False), "economy"), _page_sql("contains(http_tech, 'Economy')", "contains(lower(http_tech), 'economy')"), WIDE, "named AS (SELECT * FROM wide)")
_SHOP = "contains(http_tech, 'PROMO')"
_COUNT_PARTS = "(SELECT count(DISTINCT x) FROM (SELECT unnest(string_split({0}, '|')) AS x FROM wide) WHERE x <> '')"
add(
    "landing_page",
    lambda s, d: catalog.landing_page(wide(s, d), event_log(s, d), _at(LOG_NOW), "PROMO"),
    f"""SELECT 'totals' AS block, m.label, m.number FROM (SELECT unnest([{{'label': 'stores', 'number': (SELECT count(*) FROM wide WHERE {_SHOP})::DOUBLE}}, {{'label': 'total', 'number': (SELECT count(*) FROM wide)::DOUBLE}},
    {{'label': 'n_tech', 'number': {_COUNT_PARTS.format('http_tech')}::DOUBLE}}, {{'label': 'n_apps', 'number': {_COUNT_PARTS.format('http_apps')}::DOUBLE}}]) AS m)
    UNION ALL SELECT 'rates', l, (SELECT count(*) FROM log WHERE enriched_at > TIMESTAMP '{LOG_NOW}' - to_seconds(n) AND enriched_at <= TIMESTAMP '{LOG_NOW}')::DOUBLE FROM (VALUES ('last_minute', 60), ('last_hour', 3600)) AS v(l, n)
    UNION ALL SELECT 'recent', domain, tranco_rank::DOUBLE FROM (SELECT domain, tranco_rank FROM wide WHERE {_SHOP} AND http_title <> '' ORDER BY enriched_at DESC, domain LIMIT 20)
    UNION ALL SELECT 'top', domain, tranco_rank::DOUBLE FROM (SELECT domain, tranco_rank FROM wide WHERE {_SHOP} AND http_title <> '' {_RANK} LIMIT 10)""",
    WIDE,
    EVENT_LOG,
)
add("rate_with_tech", lambda s, d: catalog.rate(wide(s, d, apps=False), _at(f"{VIEW_NOW} 00:00:00"), 30 * 86_400, "PROMO").select("cnt"), f"SELECT count(*) AS cnt FROM wide WHERE {_SHOP} AND enriched_at > TIMESTAMP '{VIEW_NOW}' - INTERVAL 30 DAY AND enriched_at <= TIMESTAMP '{VIEW_NOW}'", WIDE)
add(
    "lookup_answers",
    lambda s, d: catalog.lookup(table(s, d, "orders").select(F.concat(F.lit(" HTTPS://"), (F.col("o_orderkey") + 1).cast("string"), F.lit("/about?x")).alias("asked")), wide(s, d, apps=False), F.lit(VIEW_NOW).cast("date")),
    f"""SELECT ' HTTPS://' || (o_orderkey + 1) || '/about?x' AS asked, CAST(o_orderkey + 1 AS VARCHAR) AS domain, CASE WHEN fresh THEN 'stored' ELSE 'enrich' END AS answer, CASE WHEN fresh THEN http_title END AS http_title, CASE WHEN fresh THEN http_tech END AS http_tech
    FROM (SELECT o.o_orderkey, w.*, coalesce(date_diff('day', CAST(w.enriched_at AS DATE), DATE '{VIEW_NOW}') < 7, false) AS fresh FROM orders o LEFT JOIN wide w ON w.domain = CAST(o.o_orderkey + 1 AS VARCHAR))""",
    WIDE,
)
_SLUGS = ["shopify-stores-using-judge-me-in-us", "shopify-stores-using-klaviyo", "shopify-stores-de", "klaviyo-vs-mail-chimp", "nothing"]
add(
    "slug_routes",
    lambda s, d: table(s, d, "customer").select("c_custkey", grades.route(_pick("c_custkey", _SLUGS)).alias("r")).select("c_custkey", "r.kind", "r.tech", "r.country"),
    f"""SELECT c_custkey, nullif({_case('c_custkey', ['tech_in_country', 'tech', 'country', 'compare', 'none'])}, 'none') AS kind, nullif({_case('c_custkey', ['Judge Me', 'Klaviyo', '', 'klaviyo|mail-chimp', 'none'])}, 'none') AS tech,
    nullif({_case('c_custkey', ['US', '', 'DE', '', 'none'])}, 'none') AS country FROM customer""",
)
_STORE_SLUGS = ["my-shop-com", "big-store-co-uk", "united-states", "shop-io", "a-b-c-com-au", "solo", "hong-kong"]
add(
    "store_slugs",
    lambda s, d: table(s, d, "customer").select("c_custkey", grades.store_route(_pick("c_custkey", _STORE_SLUGS)).alias("leads_to"), grades.slug_domain(_pick("c_custkey", _STORE_SLUGS)).alias("domain")),
    f"SELECT c_custkey, nullif({_case('c_custkey', ['', '', '/top/shopify-stores-us', '', '', '', '/top/shopify-stores-hk'])}, '') AS leads_to, {_case('c_custkey', ['my-shop.com', 'big-store.co.uk', 'united.states', 'shop.io', 'a-b-c.com.au', 'solo', 'hong.kong'])} AS domain FROM customer",
)
add("recent_errors", lambda s, d: catalog.newest(event_log(s, d).where("status = 'error'"), 50, "enriched_at", "event_id").select("event_id", "domain", "body"), "SELECT event_id, domain, body FROM log WHERE status = 'error' ORDER BY enriched_at DESC, event_id DESC LIMIT 50", EVENT_LOG)

# --- decisions that depend on the one before ----------------------------------------------------
_GAP = 43_200
_ACCEPTED = f"""accepted AS (SELECT domain, min(enriched_at) AS t FROM log GROUP BY domain UNION ALL
    SELECT a.domain, min(l.enriched_at) FROM accepted a JOIN log l ON l.domain = a.domain AND l.enriched_at >= a.t + INTERVAL {_GAP} SECOND GROUP BY a.domain, a.t)"""
add(
    "throttle",
    lambda s, d: current.throttle(event_log(s, d), "domain", "enriched_at", float(_GAP)).groupBy("k").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted")),
    f"WITH RECURSIVE {EVENT_LOG}, {_ACCEPTED} SELECT CAST(domain AS VARCHAR) AS k, n, a AS accepted FROM (SELECT domain, count(*) AS n FROM log GROUP BY domain) JOIN (SELECT domain, count(*) AS a FROM accepted GROUP BY domain) USING (domain)",
)
add(
    "wait_stats",
    lambda s, d: current.wait_stats(current.throttle(event_log(s, d), "domain", "enriched_at", float(_GAP))).select("keys", "waits", F.round("wait_s", 2).alias("wait_s"), "avg_wait_s", F.round("max_wait_s", 2).alias("max_wait_s")),
    f"""WITH RECURSIVE {EVENT_LOG}, {_ACCEPTED}, w AS (SELECT l.domain, {_GAP} - epoch(l.enriched_at - max(a.t)) AS wait FROM log l JOIN accepted a ON a.domain = l.domain AND a.t < l.enriched_at
    WHERE NOT EXISTS (FROM accepted b WHERE b.domain = l.domain AND b.t = l.enriched_at) GROUP BY l.domain, l.enriched_at, l.event_id)
    SELECT (SELECT count(DISTINCT domain) FROM log) AS keys, count(*) AS waits, round(sum(wait), 2) AS wait_s, round(avg(wait), 1) AS avg_wait_s, round(max(wait), 2) AS max_wait_s FROM w""",
)
add(
    "tracker_eviction",
    lambda s, d: current.evict(event_log(s, d).groupBy("domain").agg(F.count("*").alias("cert_count"), F.max("enriched_at").alias("last_seen")), 10, 3, "last_seen", "domain").select("domain", "cert_count"),
    "SELECT domain, cert_count FROM (SELECT domain, count(*) AS cert_count, row_number() OVER (ORDER BY max(enriched_at), domain) AS n, count(*) OVER () AS k FROM log GROUP BY domain) WHERE k < 10 OR n > 3",
    EVENT_LOG,
)

# --- candidates and merges ----------------------------------------------------------------------
_DNS = {"dns_a": "if(page_id % 9 <> 0, '1.2.3.4', '')", "dns_mx": "if(page_id % 4 <> 0, '10:mx', '')", "dns_txt": "if(page_id % 5 <> 0, 'v=spf1 -all', 'x')"}


def _named_pages(spark, sf):
    return page_rows(spark, sf).select("page_id", F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string"), F.lit("-"), F.translate(F.col("page_id").cast("string"), "0123456789", "abcdefghij"), F.lit(".com")).alias("domain")).withColumns({k: F.expr(v) for k, v in _DNS.items()})


_PAGE_NAME = "'site' || (page_id % 7) || '-' || translate(CAST(page_id AS VARCHAR), '0123456789', 'abcdefghij') || '.com'"
_seen = lambda rows, n: rows.where(F.col("page_id") % n == 1).select("domain")
add(
    "candidate_sets",
    lambda s, d: (lambda r: enrich.candidate_flags(r, _seen(r, 3), _seen(r, 5), _seen(r, 8)).select("page_id", "for_network", "for_http", "for_registration"))(_named_pages(s, d)),
    "SELECT page_id, page_id % 9 <> 0 AS for_network, page_id % 9 <> 0 AND page_id % 8 <> 1 AND page_id % 3 <> 1 AND page_id % 4 <> 0 AND page_id % 5 <> 0 AS for_http, page_id % 9 <> 0 AND page_id % 8 <> 1 AND page_id % 5 <> 1 AS for_registration FROM page_rows",
    PAGE_ROWS,
)
add(
    "registration_candidates",
    lambda s, d: (lambda r: enrich.candidates(r, _seen(r, 5), _seen(r, 8), gate=None).select("page_id", "domain"))(_named_pages(s, d)),
    f"SELECT page_id, {_PAGE_NAME} AS domain FROM page_rows WHERE page_id % 9 <> 0 AND page_id % 8 <> 1 AND page_id % 5 <> 1",
    PAGE_ROWS,
)
add(
    "manual_candidates",
    lambda s, d: enrich.candidates(_named_pages(s, d), registries=[]).select("page_id", "domain"),
    f"SELECT page_id, {_PAGE_NAME} AS domain FROM page_rows WHERE page_id % 9 <> 0 AND page_id % 4 <> 0 AND page_id % 5 <> 0",
    PAGE_ROWS,
)
_HOSTED = ["shop.github.io", "notgithub.io", "example.com", "x.myshopify.com", "herokuapp.com", "co.uk", "ab.com", "WWW.www.uk.com", "abc.com"]
add(
    "shared_hosts",
    lambda s, d: table(s, d, "supplier").select("s_suppkey", enrich.on_shared_host(_pick("s_suppkey", _HOSTED)).alias("shared"), enrich.registry_domain(_pick("s_suppkey", _HOSTED)).alias("registry")),
    "SELECT s_suppkey, s_suppkey % 9 IN (0, 1, 3, 4) AS shared, s_suppkey % 9 IN (4, 5, 6, 7) AS registry FROM supplier",
)
add(
    "merged_answers",
    lambda s, d: enrich.merge_cached(table(s, d, "customer").select("c_custkey"), table(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey", "'cached' as org", "cast(null as int) as asn"), table(s, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey", "c_name as org", "cast(c_nationkey as int) as asn"), "c_custkey", ["org", "asn"]),
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cached' WHEN c_custkey % 2 = 0 THEN c_name END AS org, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN CAST(c_nationkey AS INTEGER) END AS asn FROM customer",
)
add(
    "merged_values",
    lambda s, d: table(s, d, "customer").select("c_custkey", text.joined(text.merge_values(F.array(F.lit("Shopify"), F.col("c_mktsegment")), F.array(F.lower("c_mktsegment"), F.lit("SHOPIFY"), F.lit("x")))).alias("tech")),
    "SELECT c_custkey, 'Shopify|' || c_mktsegment || '|x' AS tech FROM customer",
)

# --- texts and forms ----------------------------------------------------------------------------
add(
    "html_meta",
    lambda s, d: page_rows(s, d).select("page_id", html.meta_description(F.concat(F.when(F.col("page_id") % 2 == 0, '<meta name="description" content=" About it ">').otherwise("<meta content='Über uns' name='description'>"), "html")).alias("description"), html.og_type(F.concat("html", F.when(F.col("page_id") % 3 == 0, '<meta property="og:type" content=" Product ">').otherwise("<meta content='Article' property='og:type'>"))).alias("og_type")),
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'About it' ELSE 'Über uns' END AS description, CASE WHEN page_id % 3 = 0 THEN 'product' ELSE 'article' END AS og_type FROM page_rows",
    PAGE_ROWS,
)
_CLEAN = "left(regexp_replace(regexp_replace({0}, '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), 300000)"
# bytes of the longest run of whole characters within the bound
_WHOLE = "(SELECT max(c) FROM (SELECT sum(strlen(x)) OVER (ORDER BY i) AS c FROM (SELECT unnest(string_split(left(b, 1000), '')) AS x, generate_subscripts(string_split(left(b, 1000), ''), 1) AS i)) WHERE c <= 1000)"
add(
    "html_clean",
    lambda s, d: page_rows(s, d).select("page_id", F.md5(html.clean("html")).alias("clean"), F.octet_length(html.limit_body("html", 1000)).alias("body_bytes"), F.left(html.limit_body("html", 1000), F.lit(30)).alias("begins")),
    f"SELECT page_id, md5({_CLEAN.format('html')}) AS clean, CAST({_WHOLE} AS INTEGER) AS body_bytes, left(b, 30) AS begins FROM (SELECT *, regexp_extract(html, '(?is)<body[^>]*>(.*)', 1) AS b FROM page_rows)",
    PAGE_ROWS,
)
add(
    "entities_decoded",
    lambda s, d: table(s, d, "customer").select("c_custkey", html.unescape(F.concat(F.lit("&lt;b&gt;"), "c_name", F.lit("&amp;&nbsp;&copy;&ndash;&#39;&quot;&#"), (F.col("c_custkey") + 200).cast("string"), F.lit(";&#128512;&#8364;&#xZ;&#55296;&#99999999999;&#65;"))).alias("plain")),
    "SELECT c_custkey, '<b>' || c_name || '& ©–''\"' || chr(CAST(c_custkey + 200 AS INTEGER)) || chr(128512) || '€&#xZ;A' AS plain FROM customer",
)
add(
    "invalid_bytes_cut",
    lambda s, d: table(s, d, "customer").select("c_custkey", text.repair(F.concat(F.encode(F.concat("c_name", F.lit("é\tü")), "UTF-8"), F.when(F.col("c_custkey") % 2 == 0, F.unhex(F.lit("C341"))).otherwise(F.unhex(F.lit(""))), F.encode(F.lit("tail"), "UTF-8")).cast("string")).alias("mended")),
    "SELECT c_custkey, c_name || 'é ü' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'tail' END AS mended FROM customer",
)
_hide = lambda address, key: bytes([key, *(ord(c) ^ key for c in address)]).hex()
_WRITTEN = [
    '<a href="mailto:Info@Shop-One.com">', "<a href='mailto:help%40two.co.uk?x=1'>", '<i data-contact="Sales@three.io">', "write to plain.name+x@four.de now", "five [@] five [.] org", "six AT six-mail DOT net", "seven @ seven . fr", "eight{at}eight{dot}us",
    "nine&#64;nine&#46;ca", '"ten" + "@" + "ten.app"', '<p style="direction:rtl">ten.nevele@ofni</p> data-reverse moc.evlewt@eman', f'<a data-cfemail="{_hide("hidden@thirteen.tech", 0x5A)}">', "admin@shop.com x@example.com logo@2x.png a@b.zz abuse@x.com test@y.com", "none",
]
_READ = ["info@shop-one.com", "help@two.co.uk", "sales@three.io", "plain.name+x@four.de", "five@five.org", "six@six-mail.net", "seven@seven.fr", "eight@eight.us", "nine@nine.ca", "ten@ten.app", "info@eleven.net|name@twelve.com", "hidden@thirteen.tech", "", ""]
add("emails_hidden", lambda s, d: page_rows(s, d).select("page_id", text.joined(html.emails(F.concat(F.lit("<html><head>out@head.com</head><body>"), _pick("page_id", _WRITTEN)))).alias("emails")), f"SELECT page_id, {_case('page_id', _READ)} AS emails FROM page_rows", PAGE_ROWS)
_sql = lambda pattern: pattern.replace("'", "''")
_ALL = lambda pattern, group=0: f"regexp_extract_all(text, '{_sql(pattern)}', {group})"
_JOINED = lambda pattern, form=r"\1@\2.\3": f"list_transform({_ALL(pattern)}, lambda x: regexp_replace(x, '{_sql(pattern)}', '{form}'))"
_PARTS = [
    _ALL(html.MAILTO, 1), _JOINED(html.MAILTO_ENCODED), _ALL(html.DATA_ATTRIBUTE, 1), _ALL(html.RAW_ADDRESS), _JOINED(html.AT_DOT_BRACKETS), _JOINED(html.AT_DOT_WORDS), _JOINED(html.AT_DOT_SPACED), _JOINED(html.AT_DOT_BRACES), _JOINED(html.ENTITIES), _JOINED(html.SCRIPT_JOINED, r"\1@\2"),
    f"CASE WHEN contains(text, 'direction:rtl') OR contains(text, 'data-reverse') THEN list_transform({_ALL(html.REVERSED)}, lambda x: reverse(x)) ELSE [] END",
]
add(
    "emails_found",
    lambda s, d: table(s, d, "documents").select("doc_id", text.joined(html.emails("text", limit=None)).alias("emails")).where("emails <> ''"),
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN list_position(e, e[i]) = i THEN e[i] END), lambda x: x IS NOT NULL)[1:10], '|') AS emails FROM (
    SELECT doc_id, list_filter(list_transform(flatten([{', '.join(_PARTS)}]), lambda x: trim(lower(x))), lambda x: NOT regexp_matches(x, '{_sql('|'.join(html.EMAIL_REJECT))}') AND len(string_split(x, '@')) = 2
    AND split_part(x, '@', 1) <> '' AND strlen(split_part(x, '@', 2)) > 2 AND list_contains({html.EMAIL_TLDS}, string_split(split_part(x, '@', 2), '.')[-1])) AS e FROM documents) WHERE len(e) > 0""",
)
_TYPES = ["text/html; charset=utf-8", "application/xhtml+xml", "application/json", "text/xml", "application/pdf", "text/plain", "text/css", "application/javascript", "image/png", "video/mp4", "audio/ogg", " font/woff2 ;x=1", ""]
add(
    "shown_values",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", format.number("o_custkey").alias("number"), format.rank(F.col("o_orderkey") % 5 * 12345).alias("rank"), format.date(F.when(F.col("o_orderkey") % 4 == 0, "unknown").otherwise(F.concat(F.col("o_orderdate").cast("string")))).alias("day"),
        format.moment(F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.left(F.col("o_orderdate").cast("string"), F.lit(10)), F.lit("T05:06:07Z")))).alias("moment"), format.percent(F.col("o_custkey") % 100 / F.lit(64.0)).alias("share"), format.content_type(_pick("o_orderkey", _TYPES)).alias("kind"),
    ),
    f"""SELECT o_orderkey, format('{{:,}}', o_custkey) AS number, CASE WHEN o_orderkey % 5 <> 0 THEN '#' || format('{{:,}}', o_orderkey % 5 * 12345) END AS rank, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%b %d, %Y') END AS day,
    CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%b %d, %Y') || ' 05:06 UTC' ELSE '—' END AS moment, CAST(floor(o_custkey % 100 / 64.0::DOUBLE * 100 + 0.5) AS BIGINT) || '%' AS share,
    nullif({_case('o_orderkey', ['HTML', 'XHTML', 'JSON', 'XML', 'PDF', 'Text', 'CSS', 'JavaScript', 'Image', 'Video', 'Audio', 'font/woff2', ''])}, '') AS kind FROM orders""",
)
_FLAG = "chr(ascii(upper({0})) + 127397) || chr(ascii(substr(upper({0}), 2)) + 127397)"
add(
    "flags_shown",
    lambda s, d: table(s, d, "nation").select("n_nationkey", format.flag(F.lower(F.left("n_name", F.lit(2)))).alias("flag"), format.flag("n_name").alias("none"), format.language_flag(_pick("n_nationkey", ["EN-us", "pt-BR", "xx", ""])).alias("spoken")),
    f"SELECT n_nationkey, {_FLAG.format('left(n_name, 2)')} AS flag, '' AS none, CASE n_nationkey % 4 WHEN 0 THEN chr(127468) || chr(127463) WHEN 1 THEN chr(127477) || chr(127481) ELSE '' END AS spoken FROM nation",
)
add(
    "linked_data",
    lambda s, d: wide(s, d, apps=False).withColumns({"http_meta_description": F.when(F.col("tranco_rank").isNotNull(), "Shop").otherwise(""), "rdap_domain_created_at": F.col("enriched_at"), "http_emails": F.lit("a@b.io|c@d.io")}).select("domain", sinks.store_linked_data().alias("store"), sinks.answer(F.col("http_title")).alias("answer")),
    """SELECT domain, '{"@context":"https://schema.org","@type":"Organization","name":"' || http_title || '","url":"https://' || domain || '","address":{"@type":"PostalAddress","addressCountry":"' || inferred_country || '"}'
    || CASE WHEN tranco_rank IS NOT NULL THEN ',"description":"Shop"' ELSE '' END || ',"foundingDate":"' || strftime(enriched_at, '%Y-%m-%d') || '","email":"a@b.io"}' AS store, '{"ok":true,"data":"' || http_title || '"}' AS answer FROM wide""",
    WIDE,
)
_REASONS = ["pool_timeout waiting", "nxdomain", "econnrefused", "tls handshake", "odd", None, None, None]
add(
    "request_metrics",
    lambda s, d: sinks.metrics(event_log(s, d).select((F.col("response_time") * 10).alias("ms"), _pick("event_id", _REASONS).alias("reason")), "ms", "reason", 600.0),
    """SELECT count(*) AS total, count(*) FILTER (k > 4) AS successful, count(*) FILTER (k > 4 AND ms < 200) AS fast, count(*) FILTER (k > 4 AND ms >= 200 AND ms < 1000) AS medium, count(*) FILTER (k > 4 AND ms >= 1000) AS slow, count(*) FILTER (k = 0) AS pool_timeouts,
    count(*) FILTER (k = 1) AS dns_errors, count(*) FILTER (k = 2) AS connection_errors, count(*) FILTER (k = 3) AS tls_errors, count(*) FILTER (k = 4) AS other_errors, floor(count(*) FILTER (k > 4) / 600.0::DOUBLE * 100 + 0.5) / 100 AS rate FROM (SELECT response_time * 10 AS ms, event_id % 8 AS k FROM log)""",
    EVENT_LOG,
)
add(
    "csv_lines",
    lambda s, d: sinks.csv_lines(table(s, d, "part").select("p_partkey", F.concat(F.lit('a "b"'), F.when(F.col("p_partkey") % 2 == 0, ", c").otherwise("")).alias("x"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("y"))),
    """SELECT p_partkey || ',"a ""b""' || CASE WHEN p_partkey % 2 = 0 THEN ', c' ELSE '' END || '",' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS line FROM part""",
)

# --- labels and models --------------------------------------------------------------------------
_MX = ["10:aspmx.l.google.com|20:x.outlook.com", "10:mail.protonmail.ch", "1:mx.zoho.eu", "", "5:own.example.net", "10:mx.pphosted.com"]
_NS = ["ns1.cloudflare.com|x", "pdns.ultradns.net", "ns1.unknown-host.net", "", "NS1.AWSDNS-1.ORG"]
_TXT = ["v=spf1 include:a include:b include:c -all|v=DMARC1; p=reject", "v=spf1 include:a ~all|k=rsa; p=x", "v=spf1 include:a", "none|v=DMARC1; p=none", ""]
add(
    "mail_and_dns_grades",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", grades.mail_provider(_pick("c_custkey", _MX)).alias("store_mail"), grades.mail_provider(_pick("c_custkey", _MX), grades.TECH_MAIL).alias("tech_mail"), grades.explorer_mail_provider(_pick("c_custkey", _MX)).alias("explorer_mail"), grades.dns_provider(_pick("c_custkey", _NS)).alias("dns"),
        grades.spf_grade(_pick("c_custkey", _TXT)).alias("spf"), grades.dmarc_grade(_pick("c_custkey", _TXT)).alias("dmarc"), detect.has_spf(_pick("c_custkey", _TXT)).alias("has_spf"), detect.has_dmarc(_pick("c_custkey", _TXT)).alias("has_dmarc"), F.size(text.values(_pick("c_custkey", _MX))).alias("hosts"),
    ),
    f"""SELECT c_custkey, nullif({_case('c_custkey', ['Google Workspace', 'ProtonMail', 'Zoho Mail', '', '', 'Proofpoint'])}, '') AS store_mail, nullif({_case('c_custkey', ['Google Workspace', 'ProtonMail', 'Zoho Mail', '', '', 'Proofpoint'])}, '') AS tech_mail,
    nullif({_case('c_custkey', ['Google Workspace', 'Proton Mail', 'Zoho Mail', '', '', 'Proofpoint'])}, '') AS explorer_mail, nullif({_case('c_custkey', ['Cloudflare', 'UltraDNS', 'unknown-host.net', '', 'Amazon Route 53'])}, '') AS dns,
    nullif({_case('c_custkey', ['gold', 'silver', 'bronze', '', ''])}, '') AS spf, nullif({_case('c_custkey', ['gold', 'silver', '', 'silver', ''])}, '') AS dmarc, c_custkey % 5 < 3 AS has_spf, c_custkey % 5 IN (0, 3) AS has_dmarc, CAST(CASE c_custkey % 6 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS INTEGER) AS hosts FROM customer""",
)
_EVIDENCE = "tranco:top_100k:25741→mid_market|registrar:GoDaddy→micro|cms:Shopify→small|majestic:beyond→x"
add(
    "evidence_badges",
    lambda s, d: table(s, d, "nation").select("n_nationkey", F.explode(detect.evidence_items(F.lit(_EVIDENCE))).alias("e")).select("n_nationkey", "e.signal", "e.value", "e.bracket", format.evidence_badge(F.col("e.signal"), F.col("e.value")).alias("badge")),
    "SELECT n_nationkey, s AS signal, v AS value, b AS bracket, g AS badge FROM nation, (VALUES ('tranco', 'top_100k:25741', 'mid_market', 'gold'), ('registrar', 'GoDaddy', 'micro', 'bronze'), ('cms', 'Shopify', 'small', 'bronze'), ('majestic', 'beyond', 'x', 'silver')) AS t(s, v, b, g)",
)
add(
    "threat_flags",
    lambda s, d: table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "true").otherwise("").alias("is_malware"), F.when(F.col("c_custkey") % 4 == 0, "1").alias("is_phishing"), F.lit("no").alias("is_disposable_email")).select("c_custkey", detect.threat("is_malware", "is_phishing", "is_disposable_email").alias("threat"), text.has_value(F.col("c_custkey") % 2).alias("odd")),
    "SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 4 = 0 AS threat, c_custkey % 2 <> 0 AS odd FROM customer",
)
_SNIPPETS = [
    "<p>", '<script src="https://www.googletagmanager.com/gtag/js?id=1"></script>', '<link rel=x href="https://fonts.googleapis.com/css">', '<meta name="generator" content="Hugo 0.1">', "<script>window.ShopifyAnalytics = {}</script>",
    '<div ng-app="x">', '<img src="https://x.imgix.net/a.png">', "<div data-v-1a2b3c4d>", '<script src="https://unpkg.com/react@18/x.js"></script>', "<a>",
]
_TECHS = ["Nginx", "Google Analytics", "Google Fonts", "Hugo", "Shopify", "AngularJS", "Imgix", "Vue.js", "React|unpkg", "Cloudflare"]


def _responses(spark, sf):
    """Pages as responses, each with a trace of something to detect."""
    headers = F.when(F.col("page_id") % 10 == 0, F.create_map(F.lit("server"), F.lit("nginx/1.2"))).when(F.col("page_id") % 10 == 9, F.create_map(F.lit("cf-ray"), F.lit("1"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    return page_rows(spark, sf).select("page_id", F.concat("html", _pick("page_id", _SNIPPETS)).alias("body"), headers.alias("headers"))


add("tech_detected", lambda s, d: detect.detect_tech(_responses(s, d)).select("page_id", text.joined("tech").alias("tech"), detect.cdn("headers").alias("cdn"), detect.blocked("body", "headers").alias("blocked")), f"SELECT page_id, {_case('page_id', _TECHS)} AS tech, CASE WHEN page_id % 10 = 9 THEN 'cloudflare' ELSE '' END AS cdn, '' AS blocked FROM page_rows", PAGE_ROWS)
_APPS = ['<script src="https://cdn.judge.me/x.js">', '<link href="/wp-content/plugins/elementor/x.css">', '<div class="jdgm-widget">', "<!-- Rank Math SEO -->", "<script src=https://static.klaviyo.com/x></script>"]
_BLOCKED_PAGES = ["Checking your browser ... Cloudflare", "Sucuri Website Firewall", "Incapsula incident", '<script></script><script></script><div id="root">', "mod_security"]
add("apps_detected", lambda s, d: page_rows(s, d).select("page_id", text.joined(detect.detect_apps(F.concat("html", _pick("page_id", _APPS)))).alias("apps")), f"SELECT page_id, {_case('page_id', ['Judge.me', 'Elementor', 'Judge.me', 'Rank Math', 'Klaviyo'])} AS apps FROM page_rows", PAGE_ROWS)
add(
    "blocked_pages",
    lambda s, d: page_rows(s, d).select("page_id", _pick("page_id", _BLOCKED_PAGES).alias("body"), F.expr("cast(map() as map<string,string>)").alias("headers")).select("page_id", detect.blocked("body", "headers").alias("blocked"), detect.script_site("body").alias("scripted")),
    f"SELECT page_id, {_case('page_id', ['cloudflare', 'sucuri', 'imperva', '', 'modsecurity'])} AS blocked, page_id % 5 = 3 AS scripted FROM page_rows",
    PAGE_ROWS,
)
_DNS_ROWS = {"dns_a": ["23.227.38.1", "1.2.3.4", "", "1.1.1.1"], "dns_cname": ["", "shops.myshopify.com", "", ""], "dns_mx": ["10:aspmx.l.google.com", "", "10:x.mail.protection.outlook.com", ""], "dns_txt": ["", "google-site-verification=x", "v=spf1 include:spf.protection.outlook.com", "facebook-domain-verification=1"], "bgp_asn_org": ["", "CLOUDFLARENET, US", "", ""]}
add(
    "dns_technologies",
    lambda s, d: table(s, d, "customer").select("c_custkey", *[_pick("c_custkey", v).alias(k) for k, v in _DNS_ROWS.items()]).select("c_custkey", text.joined(detect.dns_tech()).alias("tech")),
    f"SELECT c_custkey, {_case('c_custkey', ['Shopify|Google Workspace', 'Shopify|Cloudflare|Google Search Console', 'Microsoft 365', 'Meta Pixel'])} AS tech FROM customer",
)
# one site for each layer and a few together: inputs, best model and its points, all models' points, the same of the industry, layers
_SITES: list[tuple[dict[str, str], str, int, int, str, int, int, str]] = [
    ({"http_pages": "/pricing|/login|/docs"}, "SaaS", 15, 15, "", 0, 0, "pages"),
    ({"nav_links": "Practice Areas Attorneys", "ctl_tld": "law"}, "", 0, 0, "Legal", 16, 16, "nav+tld"),
    ({"http_title": "Free trial of a cloud platform"}, "SaaS", 12, 12, "", 0, 0, "keywords"),
    ({"body_text": "add to cart, skincare"}, "Ecommerce", 3, 3, "Beauty", 3, 3, "keywords"),
    ({"dns_txt": "hubspot=1|intercom", "http_og_type": "product"}, "Ecommerce", 6, 8, "Marketing", 2, 2, "schema+dns"),
    ({"http_tech": "Shopify|React", "http_apps": "Klaviyo|Loox", "http_pages": "/cart"}, "Ecommerce", 30, 30, "", 0, 0, "tech+pages"),
    ({"http_schema_type": "Dentist", "ctl_tld": "dental"}, "Consulting", 8, 8, "Healthcare", 19, 19, "schema+tld"),
    ({"http_tech": "Shopify", "http_title": "This domain for sale"}, "Ecommerce", 0, 0, "", 0, 0, ""),
    ({"ctl_tld": "edu", "http_pages": "/courses|/enroll"}, "Education", 20, 20, "Education", 12, 12, "pages+tld"),
    ({"http_tech": "Substack|Ghost"}, "Newsletter", 12, 22, "", 0, 0, "tech"),
    ({"http_pages": "/portfolio|/case-studies", "h1": "A digital agency", "http_meta_description": "email marketing"}, "Agency", 23, 23, "Marketing", 6, 6, "pages+keywords"),
    ({}, "", 0, 0, "", 0, 0, ""),
]
_INPUTS = sorted({k for site in _SITES for k in site[0]})


def _sites(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", *[_pick("c_custkey", [site[0].get(name, "") for site in _SITES]).alias(name) for name in _INPUTS])


add(
    "business_layers",
    lambda s, d: classify.classify(_sites(s, d)).select("c_custkey", "business_model", "industry", "classification_confidence", "method"),
    "WITH k(k, model, a, models, industry, b, industries, layers) AS (VALUES " + ", ".join(f"({i}, '{m}', {a}, {ms}, '{n}', {b}, {ns}, '{layers}')" for i, (_, m, a, ms, n, b, ns, layers) in enumerate(_SITES)) + f"""),
    c AS (SELECT *, floor(least(CASE WHEN a >= b THEN a / greatest(models, 1)::DOUBLE ELSE b / greatest(industries, 1)::DOUBLE END * 0.5 + least(greatest(a, b) / 25.0::DOUBLE, 1.0) * 0.5, 0.99) * 100 + 0.5) / 100 AS conf FROM k)
    SELECT c_custkey, CASE WHEN conf >= 0.55 THEN model ELSE '' END AS business_model, CASE WHEN conf >= 0.55 THEN industry ELSE '' END AS industry, CASE WHEN conf >= 0.55 THEN conf ELSE 0.0 END AS classification_confidence, CASE WHEN conf >= 0.55 THEN layers ELSE '' END AS method
    FROM customer JOIN c ON c_custkey % {len(_SITES)} = k""",
)
add(
    "second_tier_merge",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", _pick("c_custkey", ["", "SaaS", "Media"]).alias("model"), (F.col("c_custkey") % 60 / 100.0).alias("conf"), classify.second_tier(F.lit("Tool"), F.col("c_custkey") % 77 / 100.0, F.lit("Travel"), F.col("c_custkey") % 50 / 100.0).alias("t")
    ).select("c_custkey", "t.business_model", "t.industry", "t.model_confidence", "t.industry_confidence", classify.merge_tiers(F.col("model"), F.col("conf"), F.col("t.business_model"), F.col("t.model_confidence"), F.lit(100)).alias("merged")),
    """SELECT c_custkey, m AS business_model, i AS industry, mc AS model_confidence, ic AS industry_confidence, CASE WHEN conf < 0.55 AND (model = '' OR (mc >= 0.5 AND conf < 0.45)) THEN m ELSE model END AS merged FROM (
    SELECT *, CASE WHEN a >= 0.40 THEN 'Tool' ELSE '' END AS m, CASE WHEN b >= 0.35 THEN 'Travel' ELSE '' END AS i, floor(a * 100 + 0.5) / 100 AS mc, floor(b * 100 + 0.5) / 100 AS ic FROM (
    SELECT c_custkey, ['', 'SaaS', 'Media'][c_custkey % 3 + 1] AS model, c_custkey % 60 / 100.0::DOUBLE AS conf, greatest(0.0, least(1.0, (c_custkey % 77 / 100.0::DOUBLE - 0.15::DOUBLE) / 0.45::DOUBLE)) AS a, greatest(0.0, least(1.0, (c_custkey % 50 / 100.0::DOUBLE - 0.15::DOUBLE) / 0.45::DOUBLE)) AS b FROM customer))""",
)
add(
    "worker_needs",
    lambda s, d: table(s, d, "customer").select("c_custkey", grades.required_workers(F.col("c_custkey") * 10, F.col("c_custkey") % 7).alias("workers"), grades.health(F.col("c_custkey") % 100 / 100.0).alias("health"), _pollers(F.col("c_custkey") % 10 * 70_000).alias("pollers")),
    """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN CAST(ceil(c_custkey * 10 / (c_custkey % 7)::DOUBLE) AS INTEGER) END AS workers, CASE WHEN c_custkey % 100 >= 90 THEN 'ok' WHEN c_custkey % 100 >= 50 THEN 'warning' ELSE 'critical' END AS health,
    CAST(CASE WHEN lag > 500000 THEN 32 WHEN lag > 100000 THEN least(32, lag // 2000 * 2) WHEN lag > 50000 THEN 24 WHEN lag > 10000 THEN 8 ELSE 2 END AS INTEGER) AS pollers FROM (SELECT *, c_custkey % 10 * 70000 AS lag FROM customer)""",
)


def _pollers(lag):
    from ..streaming.jobs import poll_workers

    return poll_workers(lag, 32, 2, 10_000)


# one site for each group of revenue signals: its columns, points by bracket (with those that missing values give), evidence
_FIRMS: list[tuple[dict, tuple[int, int, int, int, int], list[str]]] = [
    ({"tranco_rank": "500", "rdap_registrar": "MarkMonitor Inc.", "dns_mx": "10:a.pphosted.com"}, (6, 0, 0, 26, 37), ["tranco:top_1k:500→large_enterprise", "registrar:MarkMonitor→large_enterprise", "mx:Proofpoint→enterprise"]),
    ({"majestic_rank": "40000", "majestic_ref_subnets": "600", "ctl_issuer": "DigiCert Inc"}, (12, 0, 9, 16, 5), ["majestic:top_50k:40000→enterprise", "ref_subnets:600→mid_market", "ssl_issuer:DigiCert→enterprise"]),
    ({"dns_txt": "v=spf1 include:a include:b include:c ~all|v=DMARC1; p=quarantine|docusign=1|onetrust=2"}, (8, 7, 11, 7, 0), ["spf_includes:3→small", "dmarc:p=quarantine→small", "compliance:OneTrust/TrustArc→enterprise", "tools:DocuSign→mid_market"]),
    ({"http_tech": "Marketo|HubSpot|Sitecore|Akamai|Segment"}, (14, 9, 10, 35, 14), ["martech:Marketo→enterprise", "martech:HubSpot→small", "tech_count:5→small", "cdn:Akamai→enterprise", "cms:Sitecore→enterprise", "tool:Segment→mid_market"]),
    ({"ctl_subdomain_count": "120", "ctl_subdomains": "api|staging|x", "rdap_nameservers": "a.awsdns-1.com", "dns_a": "1|2|3|4"}, (10, 6, 12, 8, 0), ["subdomains:120→enterprise", "subnames:env+api→mid_market", "ns:Route53→small", "dns_lb:4_records→mid_market"]),
    ({"http_apps": "a|b|c|d|e", "http_pages": "/enterprise|/careers", "http_emails": "a|b|c", "industry": "Finance"}, (12, 8, 14, 5, 0), ["app_count:5→small", "page:/enterprise→mid_market", "page:/careers→mid_market", "emails:3→small", "industry:Finance→mid_market"]),
    ({"rdap_domain_created_at": "1995-01-01", "bgp_asn_org": "Big Corp, US", "bgp_asn_number": "123", "http_schema_type": "Organization", "http_og_type": "website", "http_title": "Leading enterprise platform"}, (12, 1, 8, 19, 6), ["domain_age:29yr→enterprise", "hosting:own_asn:big corp→enterprise", "schema:Organization→mid_market", "title:enterprise_lang→enterprise", "title:platform_leader→mid_market"]),
    ({"tranco_rank": "500", "rdap_registrar": "MarkMonitor Inc.", "dns_mx": "10:a.pphosted.com", "http_status": ""}, (6, 0, 0, 26, 37), []),
    ({"rdap_registrar": "GoDaddy", "ctl_issuer": "R3"}, (20, 6, 0, 0, 0), ["registrar:GoDaddy→micro", "ssl_issuer:LetsEncrypt→micro"]),
    ({"tranco_rank": "2000000", "rdap_registrar": "GoDaddy", "ctl_issuer": "Let's Encrypt", "dns_mx": "1:mx.secureserver.net", "business_model": "Education"}, (24, 10, 0, 0, 0), ["tranco:beyond_1m:2000000→micro", "registrar:GoDaddy→micro", "ssl_issuer:LetsEncrypt→micro", "mx:GoDaddy→micro"]),
]
_FIRM_INPUTS = sorted({k for firm in _FIRMS for k in firm[0]})


def _firms(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", *[_pick("c_custkey", [firm[0].get(name, "200" if name == "http_status" else "") for firm in _FIRMS]).alias(name) for name in _FIRM_INPUTS])


_LABELS = "['<$1M', '$1M-$10M', '$10M-$100M', '$100M-$1B', '$1B+']"
_STAFF = "['1-10', '11-50', '51-500', '501-5000', '5001+']"
add(
    "revenue_signals",
    lambda s, d: revenue.estimate(_firms(s, d), 2024).select("c_custkey", "estimated_revenue", "estimated_employees", "revenue_confidence", "revenue_evidence"),
    "WITH k(k, p, evidence, n, good) AS (VALUES " + ", ".join(f"({i}, {list(map(float, points))}, '{'|'.join(evidence)}', {len(evidence)}, {'true' if evidence else 'false'})" for i, (_, points, evidence) in enumerate(_FIRMS)) + f"""),
    c AS (SELECT *, list_position(p, list_max(p)) AS best, floor(least(0.7 / list_sum(list_transform(p, lambda x: exp((x - list_max(p)) / 2.0))) + 0.3 * least(n / 10.0::DOUBLE, 1.0), 0.99) * 100 + 0.5) / 100 AS conf FROM k),
    o AS (SELECT *, good AND n >= 3 AND conf >= 0.40 AS ok FROM c)
    SELECT c_custkey, CASE WHEN ok THEN {_LABELS}[best] ELSE '' END AS estimated_revenue, CASE WHEN ok THEN {_STAFF}[best] ELSE '' END AS estimated_employees, CASE WHEN ok THEN conf ELSE 0.0 END AS revenue_confidence, CASE WHEN ok THEN evidence ELSE '' END AS revenue_evidence
    FROM customer JOIN o ON c_custkey % {len(_FIRMS)} = k""",
)


def _revenue_rows(spark, sf):
    return wide(spark, sf).select("domain", "http_status", "tranco_rank", "majestic_rank", "rdap_registrar", "http_tech", "http_apps", "business_model", "industry", F.lit("v=spf1 include:a include:b include:c").alias("dns_txt"), F.lit("aspmx.google.com").alias("dns_mx"))


_GAINS = {  # micro, small, mid_market, enterprise, large_enterprise, evidence
    "CASE WHEN tranco_rank IS NULL THEN [3,0,0,0,0,0] WHEN tranco_rank <= 1000 THEN [0,0,0,8,20,1] WHEN tranco_rank <= 10000 THEN [0,0,3,15,5,1] WHEN tranco_rank <= 100000 THEN [0,2,10,4,0,1] WHEN tranco_rank <= 500000 THEN [0,6,3,0,0,1] WHEN tranco_rank <= 1000000 THEN [2,4,0,0,0,1] ELSE [4,2,0,0,0,1] END",
    "CASE WHEN majestic_rank <= 5000 THEN [0,0,0,4,8,1] WHEN majestic_rank <= 50000 THEN [0,0,3,6,0,1] WHEN majestic_rank <= 500000 THEN [0,2,4,0,0,1] ELSE [0,0,0,0,0,0] END",
    "[1,4,2,0,0,1]", "[0,4,2,0,0,1]", "[4,0,0,0,0,0]",  # mail, SPF, no DMARC and no addresses
    "CASE WHEN t >= 25 THEN [0,0,4,8,0,1] WHEN t >= 15 THEN [0,1,5,2,0,1] WHEN t >= 8 THEN [0,4,2,0,0,1] WHEN t >= 3 THEN [2,2,0,0,0,1] WHEN t >= 1 THEN [3,0,0,0,0,1] ELSE [0,0,0,0,0,0] END",
    "CASE WHEN a >= 10 THEN [0,2,4,0,0,1] WHEN a >= 5 THEN [0,3,1,0,0,1] WHEN a >= 2 THEN [1,2,0,0,0,1] ELSE [0,0,0,0,0,0] END",
    "CASE WHEN industry = 'Finance' THEN [0,0,3,2,0,1] ELSE [0,0,0,0,0,0] END",
}
add(
    "revenue_brackets",
    lambda s, d: revenue.estimate(_revenue_rows(s, d), 2024).groupBy("estimated_revenue", "estimated_employees").agg(F.count("*").alias("n")),
    f"""SELECT CASE WHEN ok THEN {_LABELS}[best] ELSE '' END AS estimated_revenue, CASE WHEN ok THEN CASE WHEN staff <= 10 THEN '1-10' WHEN staff <= 50 THEN '11-50' WHEN staff <= 500 THEN '51-500' WHEN staff <= 5000 THEN '501-5000' ELSE '5001+' END ELSE '' END AS estimated_employees, count(*) AS n
    FROM (SELECT *, http_status IS NOT NULL AND g[6] >= 3 AND conf >= 0.40 AS ok, [3e5, 3e6, 3e7, 3e8, 3e9][best] / CASE business_model WHEN 'SaaS' THEN 200000 WHEN 'Ecommerce' THEN 120000 WHEN 'Agency' THEN 130000 ELSE 120000 END AS staff
    FROM (SELECT *, list_position(p, list_max(p)) AS best, floor(least(0.7 / list_sum(list_transform(p, lambda x: exp((x - list_max(p)) / 2.0))) + 0.3 * least(g[6] / 10.0::DOUBLE, 1.0), 0.99) * 100 + 0.5) / 100 AS conf
    FROM (SELECT *, g[1:5] AS p FROM (SELECT *, list_transform([1, 2, 3, 4, 5, 6], lambda i: list_sum(list_transform([{', '.join(sorted(_GAINS))}], lambda x: x[i]))::DOUBLE) AS g
    FROM (SELECT *, len(list_filter(string_split(http_tech, '|'), lambda x: x <> '')) AS t, len(list_filter(string_split(http_apps, '|'), lambda x: x <> '')) AS a FROM wide))))) GROUP BY 1, 2""",
    WIDE,
)


def _assembled(spark, sf):
    """The 55-column row of joined observations."""
    rows = wide(spark, sf, apps=False).select("domain", "http_title", "http_tech", "http_status", "tranco_rank", F.lit("23.227.38.9").alias("dns_a"), F.lit("de").alias("http_language"), F.concat(F.lit("a"), "domain", F.lit(".shop")).alias("name")).drop("domain").withColumnRenamed("name", "domain")
    return enrich.sanitize(enrich.assemble(rows, "w1", F.to_timestamp(F.lit(LOG_NOW)))).select("domain", "worker", F.date_format("enriched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "ctl_tld", "http_tech", "inferred_country", "dns_mx", "http_status", "is_malware", "majestic_rank", "bgp_ip")


add(
    "assembled_rows",
    _assembled,
    f"SELECT 'a' || domain || '.shop' AS domain, 'w1' AS worker, '{LOG_NOW}' AS \"at\", 'shop' AS ctl_tld, left(CASE WHEN http_tech = '' THEN 'Shopify' ELSE http_tech || '|Shopify' END, 2000) AS http_tech, 'DE' AS inferred_country, '' AS dns_mx, http_status, '' AS is_malware, CAST(NULL AS INTEGER) AS majestic_rank, '' AS bgp_ip FROM wide",
    WIDE,
)
add(
    "page_paths_known",
    lambda s, d: page_rows(s, d).select("page_id", text.joined(html.page_paths(F.lit('<a href="/Docs/x?a=1"><a href="about"><a href="login"><a href="https://www.shop.com/contact/"><a href="https://else.org/pricing"><a href="mailto:x"><a href="/pricingx"><a href="/preise/"><a href="x:y"><a href="/plan/pro#a"><a href="/signup">'), F.lit("shop.com"))).alias("paths")),
    "SELECT page_id, '/preise|/contact|/signup|/login|/docs/x|/plan/pro' AS paths FROM page_rows",
    PAGE_ROWS,
)
_LANGS = ['<html class="x" lang="fr-CA">', "<html lang='EN_us, de'>", '<html lang="x">', "<html>", '<html data-lang = "pt" lang = "it">']
add(
    "declared_languages",
    lambda s, d: table(s, d, "customer").select("c_custkey", html.html_language(_pick("c_custkey", _LANGS), _pick("c_custkey", ["", "", "NL;q=1", "", ""])).alias("language"), language.two_letters(_pick("c_custkey", ["eng", "nob", "zz", "und"])).alias("code")),
    f"SELECT c_custkey, {_case('c_custkey', ['fr-ca', 'en-us', 'nl', '', 'it'])} AS language, {_case('c_custkey', ['en', 'nb', 'zz', 'und'])} AS code FROM customer",
)
_NAMES = ["x.cloudflare.net", "shops.myshopify.com", "", "a.akamai.net|b.salesforce.com|c.okta.com", "x.000webhost.com"]
add(
    "dns_scores",
    lambda s, d: table(s, d, "customer").select("c_custkey", _pick("c_custkey", _NAMES).alias("dns_cname"), _pick("c_custkey", ["", "::1"]).alias("dns_aaaa"), _pick("c_custkey", ["1:a|2:b|3:google", "1:a|2:b", "5:google"]).alias("dns_mx"), F.lit("").alias("dns_txt")).select("c_custkey", dns_score.dns_scores([("google", "email", 5), ("google", "budget", 2)]).alias("x")).select("c_custkey", "x.web", "x.email", "x.budget", "x.security"),
    """SELECT c_custkey, CAST(greatest(0, least(10, [2, 4, 0, 9, -1][c_custkey % 5 + 1] + c_custkey % 2)) AS INTEGER) AS web, CAST([7, 1, 5][c_custkey % 3 + 1] AS INTEGER) AS email,
    CAST(greatest(0, least(10, [2, 4, 0, 14, -2][c_custkey % 5 + 1] + [3, 0, 2][c_custkey % 3 + 1])) AS INTEGER) AS budget, CAST(greatest(0, least(10, [2, 0, 0, 4, 0][c_custkey % 5 + 1] + c_custkey % 2)) AS INTEGER) AS security FROM customer""",
)
add(
    "schema_types",
    lambda s, d: page_rows(s, d).select("page_id", _schema(F.concat(F.lit('<script type="application/ld+json">'), _pick("page_id", ['{"@graph":[{"@type":"WebSite"},{"@type":["Organization","Dentist"]}]}', '[{"@type":"Store"},{"@type":"Product"}]', "{bad", '{"@type":"Unknown"}']), F.lit("</script>"), "html")).alias("kind")),
    f"SELECT page_id, {_case('page_id', ['Dentist', 'Product', '', ''])} AS kind FROM page_rows",
    PAGE_ROWS,
)


def _schema(c):
    from ..functions.schema_org import schema_type

    return schema_type(c)


add(
    "ages_and_months",
    lambda s, d: table(s, d, "orders").select("o_orderkey", current.month("o_orderdate").alias("month"), F.date_format(_moment(F.concat(F.left(F.col("o_orderdate").cast("string"), F.lit(10)), F.lit("T01:02:03.456Z"))), "yyyy-MM-dd HH:mm:ss").alias("moment")),
    "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS month, strftime(o_orderdate, '%Y-%m-%d') || ' 01:02:03' AS moment FROM orders",
)


def _moment(c):
    from ..sources.readers import moment

    return moment(c)


add("unseen_rows", lambda s, d: _unseen(s, d), f"SELECT c_custkey AS domain FROM customer WHERE c_custkey NOT IN (SELECT domain FROM log WHERE enriched_at >= TIMESTAMP '{LOG_NOW}' - INTERVAL 14 DAY)", EVENT_LOG)


def _unseen(spark, sf):
    from ..sources.readers import unseen

    return unseen(table(spark, sf, "customer").select(F.col("c_custkey").alias("domain")), event_log(spark, sf), _at(LOG_NOW), 14)


add("subdomains_listed", lambda s, d: page_rows(s, d).select("page_id", domains.parse_domain(F.concat(F.lit("*.a.b."), F.col("domain"))).alias("p")).select("page_id", "p.subdomain", "p.depth"), "SELECT page_id, array_to_string(l[1:len(l) - 2], '|') AS subdomain, CAST(len(l) - 2 AS INTEGER) AS depth FROM (SELECT page_id, string_split('a.b.' || domain, '.') AS l FROM page_rows)", PAGE_ROWS)
