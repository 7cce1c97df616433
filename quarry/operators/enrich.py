"""Enrichment: joins of a domain's observations, candidate filters and the assembled row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import crawl_gate, infer_country, last_label, strip_www, suffix_match
from ..functions.text import filled, merge_values, repair, values
from ..rules.lists import HIGH_VALUE_TLDS, REGISTRIES, SHARED_HOSTS
from ..schema import row_schema
from .classify import classify
from .detect import dns_tech
from .revenue import estimate

#: A side of a join is broadcast up to this many rows, counted first; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def sized(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if a count shows it to be small; the count stops just beyond the bound."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def by_domain(base: DataFrame, *sides: DataFrame, key: str = "domain") -> DataFrame:
    """Left outer joins on one key; every side has a row for a key at most.

    All joins share the key, so one shuffle of each side serves them all.
    """
    return reduce(lambda left, right: left.join(right, key, "left"), sides, base)


def by_address(base: DataFrame, asn: DataFrame, address: Column) -> DataFrame:
    """Network data by address: distinct addresses meet the table first, then go back to their rows."""
    rows = base.withColumn("bgp_ip", address)
    wanted = rows.select("bgp_ip").where(filled("bgp_ip") != "").distinct()
    return rows.join(wanted.join(asn, "bgp_ip"), "bgp_ip", "left")


def reputation(base: DataFrame, tranco: DataFrame, majestic: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Ranks and threat flags; names match without leading ``www.``; flags are ``'true'`` or empty."""
    keyed = base.withColumn("_k", strip_www("domain"))
    for side in (tranco.select(F.col("domain").alias("_k"), "tranco_rank"), majestic.select(F.col("domain").alias("_k"), "majestic_rank", "majestic_ref_subnets"), blocklist.select(F.col("domain").alias("_k"), "kind")):
        keyed = keyed.join(side, "_k", "left")
    flag = lambda kind: F.when(F.col("kind") == kind, "true").otherwise("")
    return keyed.withColumns({"is_malware": flag("malware"), "is_phishing": flag("phishing"), "is_disposable_email": flag("disposable")}).drop("_k", "kind")


def without(base: DataFrame, other: DataFrame, key: str = "domain") -> DataFrame:
    return base.join(other.select(key), key, "left_anti")


def registry_domain(domain: str | Column, registries: list[str] = REGISTRIES) -> Column:
    """A suffix run as a registry: listed, or a name of two bytes at most below a suffix."""
    name = strip_www(domain)
    labels = F.split(name, "\\.")
    return name.isin(registries) | ((F.size(labels) == 2) & (F.octet_length(labels[0]) <= 2))


def candidates(dns: DataFrame, seen: DataFrame | None = None, blocked: DataFrame | None = None, registries: list[str] = REGISTRIES, gate: list[str] | None = HIGH_VALUE_TLDS) -> DataFrame:
    """Domains worth a request: with an address, not seen lately, not blocked, no registry, and through the gate if one is given."""
    rows = dns.where(filled("dns_a") != "").where(~registry_domain("domain", list(registries)))
    if gate is not None:
        rows = rows.where(crawl_gate("domain", "dns_mx", "dns_txt", gate))
    for other in (seen, blocked):
        rows = rows if other is None else without(rows, other)
    return rows


def candidate_flags(dns: DataFrame, http_seen: DataFrame, rdap_seen: DataFrame, blocked: DataFrame, registries: list[str] = REGISTRIES, gate: list[str] = HIGH_VALUE_TLDS) -> DataFrame:
    """Which requests each domain is a candidate for, in one pass: ``for_network``, ``for_http``, ``for_registration``.

    The sides hold distinct ``domain`` values; the three share the key, so each is shuffled once.
    """
    marked = reduce(lambda rows, side: rows.join(side[0].select("domain").distinct().withColumn(side[1], F.lit(True)), "domain", "left"), ((http_seen, "_h"), (rdap_seen, "_r"), (blocked, "_b")), dns)
    none = lambda name: F.col(name).isNull()
    address = filled("dns_a") != ""
    open_ = address & none("_b") & ~registry_domain("domain", registries)
    return marked.withColumns({"for_network": address, "for_http": open_ & none("_h") & crawl_gate("domain", "dns_mx", "dns_txt", gate), "for_registration": open_ & none("_r")}).drop("_h", "_r", "_b")


def registration_server(domains: DataFrame, servers: DataFrame, domain: str = "domain") -> DataFrame:
    """``server``: the registration server of the domain's last label; ``servers`` has ``tld, url``, a row for a label."""
    return domains.withColumn("_tld", F.lower(last_label(domain))).join(sized(servers.select(F.col("tld").alias("_tld"), F.col("url").alias("server"))), "_tld", "left").drop("_tld")


def merge_cached(asked: DataFrame, cached: DataFrame, fetched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Answers to all that was asked: a cached one, else a fetched one, else nulls."""
    first = cached.select(key, F.struct(*columns).alias("_c"))
    second = fetched.select(key, F.struct(*columns).alias("_f"))
    return asked.join(first, key, "left").join(second, key, "left").withColumn("_a", F.coalesce("_c", "_f")).select(*asked.columns, *[F.col(f"_a.{c}").alias(c) for c in columns])


def on_shared_host(domain: str | Column, platforms: list[str] = SHARED_HOSTS, strict: bool = False) -> Column:
    return suffix_match(domain, platforms, strict)


def funnel(dns: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """One row: how many rows pass each condition; a single scan."""
    return dns.agg(F.count("*").alias("input"), *[F.count_if(c).alias(n) for n, c in stages.items()])


def assemble(joined: DataFrame, worker: str, as_of: Column | None = None) -> DataFrame:
    """Joined observations as the 55-column row.

    Missing strings become empty, numbers stay null.  Technologies of the page
    come first, those of DNS after; country, classification and revenue are
    derived where the input has none of its own.
    """
    have = set(joined.columns)
    text = lambda name: filled(F.col(name)) if name in have else F.lit("")
    fields = row_schema().fields
    rows = joined.withColumns({f.name: (F.lit(None).cast(f.dataType) if f.dataType.typeName() != "string" else F.lit("")) for f in fields if f.name not in have and f.name not in ("enriched_at", "worker")})
    rows = rows.withColumns({f.name: filled(f.name) for f in fields if f.dataType.typeName() == "string" and f.name != "worker"})
    rows = rows.withColumn("http_tech", F.array_join(merge_values(values("http_tech"), dns_tech()), "|"))
    rows = rows.withColumn("ctl_tld", F.when(F.col("ctl_tld") == "", last_label("domain")).otherwise(F.col("ctl_tld")))
    rows = rows.withColumn("inferred_country", F.when(F.col("inferred_country") == "", infer_country("ctl_tld", "http_language", text("rdap_country"), "bgp_asn_country")).otherwise(F.col("inferred_country")))
    rows = estimate(classify(rows.withColumns({"h1": F.col("http_h1"), "body_text": F.col("http_body_snippet"), "nav_links": text("nav_links")})), None)
    rows = rows.withColumns({"enriched_at": F.date_trunc("second", F.current_timestamp() if as_of is None else as_of), "worker": F.lit(worker)})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def sanitize(rows: DataFrame) -> DataFrame:
    """Every string column fit for a tab-separated line."""
    return rows.withColumns({f.name: repair(f.name) for f in rows.schema.fields if f.dataType.typeName() == "string"})
