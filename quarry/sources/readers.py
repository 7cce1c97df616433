"""Readers of the engine's inputs: text lists, rank files, whois and registration answers, certificate entries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.domains import parse_domain, strip_www
from ..functions.text import filled
from ..schema import ROW_DDL

RDAP_DDL = (
    "ldhName string, status array<string>, events array<struct<eventAction:string,eventDate:string>>, nameservers array<struct<ldhName:string>>, "
    "entities array<struct<roles:array<string>,vcardArray:array<string>,publicIds:array<struct<type:string,identifier:string>>>>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``pos``: lines of text files (compressed or not) without comments and blanks."""
    text = spark.read.text(path).withColumn("value", F.trim("value"))
    return text.where((F.col("value") != "") & ~F.col("value").rlike("^[#!]"))


def ranks(text: DataFrame, line: str = "line") -> DataFrame:
    """``domain, tranco_rank`` of ``rank,domain`` lines; bad lines go; of a domain listed twice the last line counts.

    ``text`` holds ``value`` and ``line``, the line's number.
    """
    parts = F.split("value", ",", 2)
    rows = text.select(F.expr("try_cast(trim(split(value, ',', 2)[0]) as int)").alias("tranco_rank"), strip_www(F.get(parts, F.lit(1))).alias("domain"), line).where("tranco_rank is not null and domain <> ''")
    return rows.groupBy("domain").agg(F.max_by("tranco_rank", line).alias("tranco_rank"))


def link_ranks(text: DataFrame, line: str = "line") -> DataFrame:
    """``domain, majestic_rank, majestic_ref_subnets`` of twelve-column lines; a header is no number and goes."""
    parts = F.split("value", ",")
    whole = lambda i: F.expr(f"try_cast(get(split(value, ','), {i}) as int)")
    rows = text.select(strip_www(F.get(parts, F.lit(2))).alias("domain"), whole(0).alias("majestic_rank"), whole(4).alias("majestic_ref_subnets"), line).where("majestic_rank is not null and domain <> ''")
    return rows.groupBy("domain").agg(F.max_by(F.struct("majestic_rank", "majestic_ref_subnets"), line).alias("r")).select("domain", "r.majestic_rank", "r.majestic_ref_subnets")


def signatures(text: DataFrame) -> DataFrame:
    """``pattern, score_type, points, comment`` of rule lines; ``pattern,name`` lines score ``match`` with no points.

    Comments, headers and lines whose points are no number go; patterns are lower case.
    """
    parts = F.split("value", ",", 4)
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    points = F.expr("try_cast(regexp_extract(split(value, ',', 4)[2], '^ *([+-]?[0-9]+)', 1) as int)")
    rows = text.where((F.col("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").rlike("^[a-zA-Z_, ]*score_type[a-zA-Z_, ]*$")).where(F.size(parts).isin(2, 4))
    whole = F.size(parts) == 4
    return rows.select(F.lower(at(0)).alias("pattern"), F.when(whole, at(1)).otherwise("match").alias("score_type"), F.when(whole, points).otherwise(0).alias("points"), F.when(whole, at(3)).otherwise(at(1)).alias("comment")).where("points is not null")


def users(table: DataFrame, **wanted: object) -> DataFrame:
    """Accounts whose columns have the wanted values, such as ``email=`` or ``id=``."""
    for name, value in wanted.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


#: Kinds of lists, the graver first.
KINDS = ["malware", "phishing", "disposable"]


def blocklist(lists: dict[str, DataFrame]) -> DataFrame:
    """``domain, kind`` of lists of ``value`` lines, plain or ``address name``; a domain on several takes the gravest kind."""
    parts = []
    for kind, text in lists.items():
        words = F.split(F.lower(F.trim("value")), "\\s+")
        name = F.coalesce(F.get(words, F.lit(1)), F.get(words, F.lit(0)))
        parts.append(text.where((F.trim("value") != "") & ~F.col("value").rlike("^\\s*[#!]")).select(strip_www(name).alias("domain"), F.lit(KINDS.index(kind)).alias("p")))
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    worst = rows.where(~F.col("domain").isin("localhost", "0.0.0.0", "")).groupBy("domain").agg(F.min("p").alias("p"))
    return worst.select("domain", F.element_at(F.array(*map(F.lit, KINDS)), F.col("p") + 1).alias("kind"))


def whois(text: DataFrame) -> DataFrame:
    """Network data of ``AS | IP | prefix | CC | registry | date | organisation`` lines; the organisation may hold bars."""
    parts = F.transform(F.split("value", "\\|"), lambda x: F.trim(x))
    at = lambda i: F.get(parts, F.lit(i))
    rows = text.where(F.size(parts) >= 7).select(
        at(1).alias("bgp_ip"), at(0).alias("bgp_asn_number"), F.array_join(F.slice(parts, F.lit(7), F.size(parts)), " | ").alias("bgp_asn_org"), at(3).alias("bgp_asn_country"), at(2).alias("bgp_asn_prefix")
    )
    return rows.where(F.col("bgp_asn_number").rlike("^[0-9]+"))


def rdap_servers(bootstrap: Column | str) -> Column:
    """Array of ``(tld, url)`` of a bootstrap document."""
    doc = F.from_json(bootstrap, "services array<array<array<string>>>")
    return F.flatten(F.transform(doc["services"], lambda s: F.transform(F.get(s, F.lit(0)), lambda t: F.struct(F.lower(t).alias("tld"), F.get(F.get(s, F.lit(1)), F.lit(0)).alias("url")))))


def moment(c: Column | str) -> Column:
    """An ISO time as timestamp: ``T`` and ``Z`` go, nineteen characters count."""
    return F.try_to_timestamp(F.left(F.replace(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")), F.lit(19)))


def rdap(answers: DataFrame, body: str = "body") -> DataFrame:
    """Registration columns of RDAP answers; an unreadable answer gives nulls and an error."""
    doc = F.from_json(body, RDAP_DDL)
    event = lambda name: moment(F.get(F.filter(F.col("_d.events"), lambda e: e["eventAction"] == name), F.lit(0))["eventDate"])
    registrar = F.filter(F.col("_d.entities"), lambda e: F.array_contains(e["roles"], "registrar"))
    # the card's second member lists [name, parameters, type, value]
    cards = F.from_json(F.get(F.get(registrar, F.lit(0))["vcardArray"], F.lit(1)), "array<array<string>>")
    name = F.get(F.filter(cards, lambda x: F.get(x, F.lit(0)) == "fn"), F.lit(0))
    return answers.withColumn("_d", doc).select(
        *[c for c in answers.columns if c != body],
        event("registration").alias("rdap_domain_created_at"),
        event("expiration").alias("rdap_domain_expires_at"),
        event("last changed").alias("rdap_domain_updated_at"),
        filled(F.get(name, F.lit(3))).alias("rdap_registrar"),
        filled(F.get(F.get(registrar, F.lit(0))["publicIds"], F.lit(0))["identifier"]).alias("rdap_registrar_iana_id"),
        filled(F.array_join(F.transform(F.col("_d.nameservers"), lambda n: F.lower(n["ldhName"])), "|")).alias("rdap_nameservers"),
        filled(F.array_join(F.col("_d.status"), "|")).alias("rdap_status"),
        F.when(F.col("_d.ldhName").isNull() & F.col("_d.events").isNull(), "unreadable").otherwise("").alias("rdap_error"),
    )


def dns_rows(raw: DataFrame) -> DataFrame:
    """DNS columns of a struct of string lists and (priority, host) pairs, as pipe-joined strings."""
    trimmed = lambda c: F.transform(F.col(c), lambda x: F.regexp_replace(x, "\\.$", ""))
    return raw.select(
        "domain",
        filled(F.array_join("a", "|")).alias("dns_a"),
        filled(F.array_join("aaaa", "|")).alias("dns_aaaa"),
        filled(F.array_join(F.transform(F.array_sort("mx"), lambda m: F.concat(m["priority"].cast("string"), F.lit(":"), F.regexp_replace(m["host"], "\\.$", ""))), "|")).alias("dns_mx"),
        filled(F.array_join(F.transform("txt", lambda t: F.translate(t, "\n\r,", "   ")), "|")).alias("dns_txt"),
        filled(F.array_join(trimmed("cname"), "|")).alias("dns_cname"),
    )


def history(spark: SparkSession, path: str) -> DataFrame:
    """A saved log: CSV with a header, in the row's schema."""
    return spark.read.csv(path, header=True, schema=ROW_DDL, quote='"', escape='"')


def log(spark: SparkSession, path: str) -> DataFrame:
    """The log's folders; the month of the path is a column to prune by."""
    return spark.read.schema(f"{ROW_DDL}, enriched_month int").parquet(path)


def newest_archive(spark: SparkSession, folder: str, pattern: str = "*.gz") -> DataFrame:
    """Lines of the archive of the greatest name in a folder."""
    rows = spark.read.text(f"{folder}/{pattern}").withColumn("_f", F.input_file_name())
    newest = rows.agg(F.max("_f")).first()[0]
    return spark.read.text(newest) if newest else rows.drop("_f")


def numbered(text: DataFrame) -> DataFrame:
    """``line``: an increasing number in file order, for sources where the last line counts."""
    return text.withColumn("line", F.monotonically_increasing_id())


def leaf(entry: str | Column) -> Column:
    """``struct(kind, der)`` of a log entry's base64 leaf: kind 0 is a certificate, 1 a precertificate."""
    raw = F.try_to_binary(F.col(entry) if isinstance(entry, str) else entry, F.lit("base64"))
    number = lambda at, n: F.conv(F.hex(F.substring(raw, at, n)), 16, 10).cast("int")
    return F.struct(number(11, 2).alias("kind"), F.substring(raw, F.lit(16), number(13, 3)).alias("der"))


def _der(data: bytes) -> tuple[str, str, list[str]] | None:
    """(subject, issuer, names) of a certificate: a walk over its tags and lengths, nothing else is decoded."""

    def items(block: bytes):
        at = 0
        while at + 2 <= len(block):
            tag, size, head = block[at], block[at + 1], 2
            if size & 0x80:
                n = size & 0x7F
                size, head = int.from_bytes(block[at + 2 : at + 2 + n], "big"), 2 + n
            yield tag, block[at + head : at + head + size]
            at += head + size

    def common_name(name: bytes) -> str:
        for _, group in items(name):
            for _, pair in items(group):
                parts = list(items(pair))
                if len(parts) == 2 and parts[0][1] == b"\x55\x04\x03":
                    return parts[1][1].decode("utf-8", "replace")
        return ""

    try:
        body = next(items(next(items(data))[1]))[1]
        parts = [x for x in items(body)]
        parts = parts[1:] if parts[0][0] == 0xA0 else parts
        issuer, subject, names = parts[2][1], parts[4][1], []
        for tag, block in parts[5:]:
            if tag == 0xA3:
                for _, extension in items(next(items(block))[1]):
                    fields = list(items(extension))
                    if fields[0][1] == b"\x55\x1d\x11":
                        names = [v.decode("ascii", "replace") for t, v in items(next(items(fields[-1][1]))[1]) if t == 0x82]
        return common_name(subject), common_name(issuer), names
    except (IndexError, StopIteration):
        return None


def certificates(entries: DataFrame, column: str = "leaf_input") -> DataFrame:
    """Certificate records of log entries; precertificates, unreadable ones and names of one label go.

    The header is read natively; the certificate itself in Arrow batches, as no
    built-in reads DER.
    """
    @F.pandas_udf("struct<subject:string,issuer:string,names:array<string>>")
    def decode(der: pd.Series) -> pd.DataFrame:
        found = [_der(bytes(x)) if x is not None else None for x in der]
        return pd.DataFrame({"subject": [f[0] if f else None for f in found], "issuer": [f[1] if f else None for f in found], "names": [f[2] if f else None for f in found]})

    rows = entries.select(leaf(column).alias("e")).where("e.kind = 0").select(decode("e.der").alias("c"))
    name = F.coalesce(F.nullif(F.col("c.subject"), F.lit("")), F.get(F.col("c.names"), F.lit(0)))
    parsed = rows.select("c", parse_domain(name).alias("p")).where("p is not null")
    return parsed.select(
        F.col("p.base").alias("ctl_domain"), F.col("p.tld").alias("ctl_tld"), F.coalesce(F.nullif(F.col("c.issuer"), F.lit("")), F.lit("Unknown")).alias("ctl_issuer"), F.col("p.depth").alias("ctl_subdomain_count"), F.col("p.subdomain").alias("ctl_subdomains")
    )


def unseen(rows: DataFrame, log_rows: DataFrame, as_of: Column, days: int, key: str = "domain") -> DataFrame:
    """Rows whose key has no log row within ``days``: a cache with a lifetime, as an anti-join."""
    recent = log_rows.where(F.col("enriched_at") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")).select(key).distinct()
    return rows.join(recent, key, "left_anti")


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
