"""Registered queries over what readers make of raw inputs: lines, answers and records written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains
from ..operators import enrich
from ..sources import readers, sinks
from .adapters import WIDE, table, wide
from .book import add


def _text(spark, sf, name, expression, line=None):
    """Lines written from a table's rows."""
    return table(spark, sf, name).select(F.expr(expression).alias("value"), *([F.expr(line).alias("line")] if line else []))


# every eleventh line is no rank; names come up again, and the last line counts
add(
    "rank_list",
    lambda s, d: readers.ranks(_text(s, d, "customer", "if(c_custkey % 11 = 0, concat('x,d', c_custkey, '.com'), concat(c_custkey, ',WWW.www.D', c_custkey % 400, '.com '))", "c_custkey")),
    "SELECT 'd' || (c_custkey % 400) || '.com' AS domain, CAST(max(c_custkey) AS INTEGER) AS tranco_rank FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1",
)
add(
    "link_rank_list",
    lambda s, d: readers.link_ranks(_text(s, d, "customer", "if(c_custkey % 13 = 0, 'GlobalRank,TldRank,Domain,TLD,RefSubNets,RefIPs', concat(c_custkey, ',7,www.D', c_custkey, '.com,com,', c_nationkey * 3, ',9,a,b,1,1,1,1'))", "c_custkey")),
    "SELECT 'd' || c_custkey || '.com' AS domain, CAST(c_custkey AS INTEGER) AS majestic_rank, CAST(c_nationkey * 3 AS INTEGER) AS majestic_ref_subnets FROM customer WHERE c_custkey % 13 <> 0",
)
add(
    "blocklist_union",
    lambda s, d: readers.blocklist({
        "malware": _text(s, d, "customer", "if(c_custkey % 6 = 0, concat('0.0.0.0 www.D', c_custkey, '.com'), if(c_custkey % 5 = 0, '127.0.0.1 localhost', '# none'))"),
        "phishing": _text(s, d, "customer", "if(c_custkey % 4 = 0, concat('d', c_custkey, '.com'), '')"),
        "disposable": _text(s, d, "customer", "if(c_custkey % 3 = 0, concat('  D', c_custkey, '.com  '), '! none')"),
    }),
    "SELECT 'd' || c_custkey || '.com' AS domain, CASE WHEN c_custkey % 6 = 0 THEN 'malware' WHEN c_custkey % 4 = 0 THEN 'phishing' ELSE 'disposable' END AS kind FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 4 = 0 OR c_custkey % 3 = 0",
)
add(
    "whois_lines",
    lambda s, d: readers.whois(_text(s, d, "supplier", "case s_suppkey % 5 when 0 then 'Bulk mode; whois.example' when 1 then concat('NA | 10.0.', s_suppkey, '.1 | NA | | other | | NA') else concat(s_suppkey, '   | 10.0.', s_suppkey, '.1  | 10.0.0.0/8 | US | arin | 2010-01-01 | ', s_name, ' | Inc') end")),
    "SELECT '10.0.' || s_suppkey || '.1' AS bgp_ip, CAST(s_suppkey AS VARCHAR) AS bgp_asn_number, s_name || ' | Inc' AS bgp_asn_org, 'US' AS bgp_asn_country, '10.0.0.0/8' AS bgp_asn_prefix FROM supplier WHERE s_suppkey % 5 > 1",
)


def _servers(spark, sf):
    """Bootstrap documents, one for each nation, as (tld, url)."""
    doc = "concat('{\"version\":\"1.0\",\"services\":[[[\"N', n_nationkey, '\",\"x', n_nationkey, '\"],[\"https://r', n_nationkey, '.example/\",\"http://old/\"]],[[\"both', n_nationkey, '\"],[\"https://b.example/\"]]]}')"
    return table(spark, sf, "nation").select(F.explode(readers.rdap_servers(F.expr(doc))).alias("s")).select("s.tld", "s.url")


_SERVERS = "servers AS (SELECT p || n_nationkey AS tld, CASE p WHEN 'both' THEN 'https://b.example/' ELSE 'https://r' || n_nationkey || '.example/' END AS url FROM nation, (VALUES ('n'), ('x'), ('both')) AS v(p))"
add("registration_servers", _servers, "SELECT tld, url FROM servers", _SERVERS)
add(
    "registration_server_join",
    lambda s, d: enrich.registration_server(table(s, d, "customer").select("c_custkey", F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.lit(".co.N"), (F.col("c_nationkey") + 3).cast("string")).alias("domain")), _servers(s, d)).select("c_custkey", "domain", "server"),
    "SELECT c_custkey, 'd' || c_custkey || '.co.N' || (c_nationkey + 3) AS domain, url AS server FROM customer LEFT JOIN servers ON tld = 'n' || (c_nationkey + 3)",
    _SERVERS,
)
_ANSWER = (
    "if(s_suppkey % 9 = 0, 'not found', concat('{\"ldhName\":\"D', s_suppkey, '.COM\",\"status\":[\"active\",\"locked\"],\"events\":[{\"eventAction\":\"registration\",\"eventDate\":\"', 1990 + s_suppkey % 30, '-03-04T05:06:07Z\"},"
    "{\"eventAction\":\"last changed\",\"eventDate\":\"2020-01-02T03:04:05.123Z\"}],\"nameservers\":[{\"ldhName\":\"NS1.X', s_suppkey, '.NET\"},{\"ldhName\":\"ns2.y.net\"}],"
    "\"entities\":[{\"roles\":[\"abuse\"]},{\"roles\":[\"registrar\"],\"vcardArray\":[\"vcard\",[[\"version\",{},\"text\",\"4.0\"],[\"fn\",{},\"text\",\"', s_name, '\"]]],\"publicIds\":[{\"type\":\"IANA Registrar ID\",\"identifier\":\"', s_nationkey, '\"}]}]}'))"
)
add(
    "registration_answers",
    lambda s, d: readers.rdap(table(s, d, "supplier").select("s_suppkey", F.expr(_ANSWER).alias("body"))).select(
        "s_suppkey", F.year("rdap_domain_created_at").alias("created"), F.date_format("rdap_domain_updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.isnull("rdap_domain_expires_at").alias("no_expiry"), "rdap_registrar", "rdap_registrar_iana_id", "rdap_nameservers", "rdap_status", "rdap_error"
    ),
    """SELECT s_suppkey, CASE WHEN ok THEN CAST(1990 + s_suppkey % 30 AS INTEGER) END AS created, CASE WHEN ok THEN '2020-01-02 03:04:05' END AS updated, true AS no_expiry, CASE WHEN ok THEN s_name ELSE '' END AS rdap_registrar,
    CASE WHEN ok THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS rdap_registrar_iana_id, CASE WHEN ok THEN 'ns1.x' || s_suppkey || '.net|ns2.y.net' ELSE '' END AS rdap_nameservers, CASE WHEN ok THEN 'active|locked' ELSE '' END AS rdap_status,
    CASE WHEN ok THEN '' ELSE 'unreadable' END AS rdap_error FROM (SELECT *, s_suppkey % 9 <> 0 AS ok FROM supplier)""",
)
_RAW_DNS = [
    "concat('d', s_suppkey, '.com') as domain", "transform(sequence(1, 1 + s_suppkey % 3), i -> concat('10.0.0.', i)) as a", "if(s_suppkey % 2 = 0, array('::1'), cast(null as array<string>)) as aaaa",
    "array(named_struct('priority', 20, 'host', 'mx2.example.com.'), named_struct('priority', cast(5 + s_suppkey % 20 as int), 'host', 'mx1.example.com')) as mx", "array('v=spf1 a,b\\nc', concat('id=', s_suppkey)) as txt", "array('host.example.net.') as cname",
]
add(
    "dns_records",
    lambda s, d: readers.dns_rows(table(s, d, "supplier").selectExpr(*_RAW_DNS)),
    """SELECT 'd' || s_suppkey || '.com' AS domain, array_to_string(list_transform(range(1, CAST(2 + s_suppkey % 3 AS INTEGER)), lambda i: '10.0.0.' || i), '|') AS dns_a, CASE WHEN s_suppkey % 2 = 0 THEN '::1' ELSE '' END AS dns_aaaa,
    CASE WHEN 5 + s_suppkey % 20 <= 20 THEN (5 + s_suppkey % 20) || ':mx1.example.com|20:mx2.example.com' ELSE '20:mx2.example.com|' || (5 + s_suppkey % 20) || ':mx1.example.com' END AS dns_mx,
    'v=spf1 a b c|id=' || s_suppkey AS dns_txt, 'host.example.net' AS dns_cname FROM supplier""",
)
add(
    "rule_lines",
    lambda s, d: readers.signatures(_text(s, d, "part", "case p_partkey % 5 when 0 then '# comment' when 1 then 'pattern,score_type,points,comment' when 2 then concat(' ', p_brand, ' ,', p_name, ' x') when 3 then concat(p_name, ',web, ', p_size, ' ,', p_type, ', and more') else concat(p_name, ',web,many,none') end")),
    """SELECT lower(trim(CASE p_partkey % 5 WHEN 2 THEN p_brand ELSE p_name END)) AS pattern, CASE p_partkey % 5 WHEN 2 THEN 'match' ELSE 'web' END AS score_type, CAST(CASE p_partkey % 5 WHEN 2 THEN 0 ELSE p_size END AS INTEGER) AS points,
    CASE p_partkey % 5 WHEN 2 THEN p_name || ' x' ELSE p_type || ', and more' END AS comment FROM part WHERE p_partkey % 5 IN (2, 3)""",
)
add(
    "account_lookup",
    lambda s, d: readers.users(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@mail.example")).alias("email"), F.col("c_mktsegment").alias("plan")), plan="BUILDING"),
    "SELECT c_custkey AS id, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@mail.example' AS email, c_mktsegment AS plan FROM customer WHERE c_mktsegment = 'BUILDING'",
)


def _certificate(name: str) -> bytes:
    """A certificate with little but what is read of it: issuer, subject and names."""
    def tag(kind: int, *parts: bytes) -> bytes:
        body = b"".join(parts)
        size = len(body)
        return bytes([kind]) + (bytes([size]) if size < 128 else bytes([0x82, size >> 8, size & 255])) + body

    common = lambda text: tag(0x30, tag(0x31, tag(0x30, b"\x06\x03\x55\x04\x03", tag(0x0C, text.encode()))))
    names = tag(0x30, b"\x06\x03\x55\x1d\x11", tag(0x04, tag(0x30, tag(0x82, name.encode()), tag(0x82, b"www.example.org"))))
    body = tag(0x30, tag(0xA0, b"\x02\x01\x02"), b"\x02\x01\x05", tag(0x30, b"\x06\x01\x2a"), common("Issuer One"), tag(0x30), common(name), tag(0x30), tag(0xA3, tag(0x30, names)))
    return tag(0x30, body, tag(0x30, b"\x06\x01\x2a"), b"\x03\x01\x00")


_SAMPLE = "xxxxxxxx.shop.example.co.uk"
_HEX = _certificate(_SAMPLE).hex()
_BEFORE_NAME, _BETWEEN, _AFTER_NAME = _HEX.split(_SAMPLE.encode().hex())
# entries of a log: every third is a precertificate, every seventh cannot be read
_LEAF = (
    "base64(if(c_custkey % 7 = 0, unhex('00'), unhex(concat('0000', '0000000000000000', if(c_custkey % 3 = 0, '0001', '0000'), '"
    + f"{len(_HEX) // 2:06x}', '{_BEFORE_NAME}', n, '{_BETWEEN}', n, '{_AFTER_NAME}'))))"
)


def _entries(spark, sf):
    name = F.hex(F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(_SAMPLE[8:])))
    return table(spark, sf, "customer").withColumn("n", name).select(F.expr(_LEAF).alias("leaf_input"))


add(
    "certificate_records",
    lambda s, d: readers.certificates(_entries(s, d)).groupBy("ctl_domain", "ctl_tld", "ctl_issuer", "ctl_subdomain_count", "ctl_subdomains").agg(F.count("*").alias("n")),
    "SELECT 'example.co.uk' AS ctl_domain, 'co.uk' AS ctl_tld, 'Issuer One' AS ctl_issuer, CAST(2 AS INTEGER) AS ctl_subdomain_count, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '|shop' AS ctl_subdomains, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 GROUP BY ALL",
)


def _saved(spark, sf):
    """The view written as CSV with a header and read back in the row's schema."""
    from ..schema import row_schema
    from ..streaming.jobs import work_dir

    rows = wide(spark, sf)
    have = set(rows.columns)
    full = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in row_schema().fields])
    path = f"{work_dir(spark)}/saved"
    sinks.write_csv(full, path)
    back = readers.history(spark, path)
    return back.select("domain", *[F.coalesce(c, F.lit("")).alias(c) for c in ("http_title", "http_tech", "business_model", "industry")], "http_status", "tranco_rank", F.date_format("enriched_at", "yyyy-MM-dd").alias("day"))


add("csv_restore", _saved, "SELECT domain, http_title, http_tech, business_model, industry, http_status, tranco_rank, strftime(enriched_at, '%Y-%m-%d') AS day FROM wide", WIDE)


def _archived(spark, sf):
    """Rank archives of three days, of which the retention keeps two, and the newest read back."""
    from ..streaming.jobs import work_dir

    path = f"{work_dir(spark)}/ranks"
    ranks = table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("tranco_rank"), F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"))
    for day, least in (("2024-01-01", 0), ("2024-01-20", 3), ("2024-02-15", 10)):
        gone = sinks.dated_archive(ranks.where(F.col("tranco_rank") > least), path, "tranco_rank", day)
    rows = readers.ranks(readers.numbered(readers.newest_archive(spark, path, "day=*/*.gz")))
    return rows.withColumn("dropped", F.lit(",".join(gone)))


add("archive_restore", _archived, "SELECT 'd' || c_custkey || '.com' AS domain, CAST(c_custkey AS INTEGER) AS tranco_rank, 'day=2024-01-01' AS dropped FROM customer WHERE c_custkey > 10 AND c_custkey <= 1000010")
add(
    "names_normalised",
    lambda s, d: table(s, d, "customer").select("c_custkey", domains.strip_www(F.concat(F.lit(" WWW.www."), "c_name", F.lit(".Com"))).alias("bare"), domains.last_label(F.concat(F.lit("a.b.t"), F.col("c_nationkey").cast("string"))).alias("tld"), domains.lookup_name(F.concat(F.lit(" HTTPS://"), "c_name", F.lit(".com/path/x"))).alias("asked")),
    "SELECT c_custkey, lower(c_name) || '.com' AS bare, 't' || c_nationkey AS tld, lower(c_name) || '.com' AS asked FROM customer",
)
