"""Log operators, joins, filters, the classifier and the revenue model."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, classify, current, enrich, predicates, revenue
from quarry.schema import row_schema

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def view(spark):
    rows = [
        ("a.com", at(0), "Shopify|React", "A", 5, "DE", "Ecommerce", 200, 1), ("a.com", at(9), "Shopify|Vue.js", "A2", 4, "DE", "Ecommerce", 200, 2), ("a.com", at(9), "shopify", "A3", None, "DE", "Ecommerce", 200, 3),
        ("b.com", at(5), "React||Vue.js", "B", None, "", "Blog", None, 4), ("c_x.com", at(5), "Ac_me|100%", "", 4, "US", "SaaS", 404, 5), ("d.com", at(-40 * 86400), "Shopify", "D'x", 7, "US", "Blog", 200, 6),
    ]
    names = "domain string, enriched_at timestamp_ntz, http_tech string, http_title string, tranco_rank int, inferred_country string, business_model string, http_status int, id int"
    return spark.createDataFrame(rows, names).withColumns({"ctl_tld": F.lit("com"), "http_language": F.lit("en"), "bgp_asn_country": F.lit(""), "bgp_ip": F.lit(""), "http_apps": F.lit(""), "industry": F.lit("")})


def test_latest_row_wins_and_ties_are_settled(view):
    assert {(r.domain, r.id) for r in current.latest(view, tie="id").collect()} == {("a.com", 3), ("b.com", 4), ("c_x.com", 5), ("d.com", 6)}


def test_catalog(view):
    rows = current.latest(view, tie="id")
    assert catalog.store_count(rows).first().cnt == 1 and catalog.store_count(rows, "SHOPIFY", True).first().cnt == 2
    assert catalog.store_count(rows, "c_m").first().cnt == 1 and catalog.store_count(rows, "cXm").first().cnt == 0
    assert [r.domain for r in catalog.ranked(rows, None).collect()] == ["c_x.com", "d.com", "a.com", "b.com"]
    assert {(r.tech, r.cnt) for r in catalog.directory(rows, least=1).collect()} == {("shopify", 1), ("React", 1), ("Vue.js", 1), ("Ac_me", 1), ("100%", 1), ("Shopify", 1)}
    assert [r.domain for r in catalog.explore(rows, {"domain": "C_X"}).collect()] == ["c_x.com"]
    assert catalog.explore(rows, {}, 2, 3).count() == 1 and catalog.explore_count(rows, {"country": "US, DE", "bogus": "1"}).first().cnt == 4
    assert {r.domain for r in catalog.explore(rows, {"business_model": "Shopify,SaaS"}).collect()} == {"a.com", "c_x.com", "d.com"}
    assert [r.domain for r in catalog.stale_domains(rows, F.lit(at(10)), 7, 30).collect()] == ["d.com"]
    assert [r.value for r in catalog.distinct_parts(rows, needle="RE").collect()] == ["React"]
    assert catalog.detail(rows, "a.com").first().http_title == "A3"


def test_filters_ignore_empty(spark, view):
    assert view.where(predicates.explorer_filter({"tech": "", "country": None, "freshness": "99d"}, F.col("inferred_country"))).count() == view.count()
    assert predicates.page(view.orderBy("id"), 0, 2).count() == 2


def test_throttle_counts_from_the_last_accepted(spark):
    rows = spark.createDataFrame([("k", at(s)) for s in (0, 1, 2, 3, 4, 7)] + [("j", at(1))], "k string, t timestamp_ntz")
    out = current.throttle(rows, "k", "t", 3.0).orderBy("k", "at").collect()
    assert [r.accepted for r in out] == [True, True, False, False, True, False, True]


def test_quota_and_batches(spark):
    rows = spark.createDataFrame([(1, "u", at(i)) for i in range(0, 70, 10)], "x int, u string, t timestamp_ntz").withColumn("id", F.unix_seconds(F.col("t").cast("timestamp")) - 1704067200)
    out = current.quota(rows, "u", "t", "id", F.lit(4)).orderBy("t").collect()
    assert [r.allowed for r in out] == [True] * 4 + [False] * 2 + [True]
    assert sorted((r.id, r.batch_id) for r in current.batches(rows, "id", 3, 4).collect()) == [(i * 10, i // 3) for i in range(7)]
    assert current.batches(rows.limit(0), "id", 3).isEmpty()


def test_platform_flags(spark):
    rows = spark.createDataFrame([(i, "busy", at(i * 60), 1) for i in range(90)] + [(200, "wide", at(0), 150), (201, "wide", at(4000), 1), (300, "calm", at(0), 1), (301, "calm", at(9000), 2)], "id int, d string, t timestamp_ntz, n int")
    out = {r.id: r.is_platform for r in current.platform_flags(rows, "d", "t", "id", F.col("n")).collect()}
    assert not out[59] and out[60] and out[201] and not out[200] and not out[301]


def test_log_is_partitioned_by_month(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 5)), ("b", dt.datetime(2024, 2, 5))], "domain string, enriched_at timestamp")
    current.append(rows, f"{tmp_path}/log")
    current.append(rows, f"{tmp_path}/log")
    assert {x for x in os.listdir(f"{tmp_path}/log") if x.startswith("enriched")} == {"enriched_month=202401", "enriched_month=202402"}
    back = current.since(spark.read.parquet(f"{tmp_path}/log"), F.lit(dt.datetime(2024, 2, 1)), partition="enriched_month")
    assert [r.domain for r in back.collect()] == ["b", "b"]
    assert "PartitionFilters: [isnotnull(enriched_month" in back._jdf.queryExecution().toString()
    from quarry.sources.sinks import drop_months

    assert drop_months(spark, f"{tmp_path}/log", 202402) == ["enriched_month=202401"]


def site(**values):
    return tuple(values.get(n, "") for n in classify.INPUTS)


CASES = [
    (site(http_tech="Shopify|React", http_apps="Klaviyo|Judge.me", http_title="Natural skincare", http_pages="/collections|/cart|/products", body_text="serums"), "Ecommerce", "Beauty", 0.7),
    (site(http_title="HR software", http_pages="/pricing|/login|/docs|/api", http_schema_type="SoftwareApplication", body_text="payroll"), "SaaS", "HR & Recruiting", 0.8),
    (site(http_schema_type="LegalService", ctl_tld="law", nav_links="Practice Areas"), "Consulting", "Legal", 0.8),
    (site(http_tech="Substack", http_title="fintech news"), "Newsletter", "Fintech", 0.55),
    (site(http_title="A digital agency", http_pages="/portfolio|/case-studies", http_meta_description="email marketing"), "Agency", "Marketing", 0.6),
    (site(http_title="AI-powered writing", http_schema_type="SoftwareApplication", http_pages="/pricing|/login|/docs"), "SaaS", "AI & ML", 0.8),
    (site(http_schema_type="FurnitureStore", http_tech="Shopify", http_pages="/cart"), "Ecommerce", "Home & Garden", 0.8),
    (site(http_schema_type="CollegeOrUniversity", ctl_tld="edu"), "Education", "Education", 0.8),
    (site(), "", "", 0.0),
    (tuple([None] * len(classify.INPUTS)), "", "", 0.0),
    (site(http_tech="Shopify", http_title="Opening Soon"), "", "", 0.0),
    (site(http_tech="Shopify", body_text="Buy this domain today"), "", "", 0.0),
]


def test_classifier_scenarios(spark):
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], "i int, " + ", ".join(f"{n} string" for n in classify.INPUTS))
    for r in classify.classify(rows).collect():
        _, model, industry, least = CASES[r.i]
        assert (r.business_model, r.industry) == (model, industry) and least <= r.classification_confidence <= 0.99, r
    first = classify.classify(rows).where("i = 0").first()
    assert first.method == "tech+pages+keywords"


REVENUE = [
    (dict(http_status=200, tranco_rank=500, rdap_registrar="MarkMonitor Inc.", dns_mx="x.pphosted.com"), {"$1B+"}, ["tranco", "registrar"]),
    (dict(http_status=200, tranco_rank=5_000_000, rdap_registrar="GoDaddy", ctl_issuer="R3", dns_mx="secureserver.net"), {"<$1M"}, []),
    (dict(http_status=200, tranco_rank=90_000, dns_txt="v=spf1 include:mktomail.com", http_tech="Marketo|React"), {"$10M-$100M", "$100M-$1B"}, ["Marketo"]),
    (dict(http_status=200, http_tech="Sitecore|Akamai", tranco_rank=40_000), {"$100M-$1B", "$1B+"}, ["Sitecore", "Akamai"]),
    (dict(http_status=200, http_tech="Wix", rdap_registrar="GoDaddy", dns_mx="secureserver.net"), {"<$1M"}, ["Wix"]),
    (dict(http_status=200, tranco_rank=90_000, ctl_subdomains="api|staging|dev|docs", rdap_nameservers="ns1.ultradns.net", dns_a="1|2|3|4|5|6|7|8", industry="Finance"), None, ["subnames", "UltraDNS", "dns_lb", "Finance"]),
    (dict(tranco_rank=500, rdap_registrar="MarkMonitor", dns_mx="pphosted"), {""}, []),
    ({}, {""}, []),
]


def test_revenue_scenarios(spark):
    names = sorted({k for c, _, _ in REVENUE for k in c})
    kinds = {"http_status": "int", "tranco_rank": "int"}
    rows = spark.createDataFrame([(i, *[c.get(n) for n in names]) for i, (c, _, _) in enumerate(REVENUE)], "i int, " + ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    for r in revenue.estimate(rows, 2024).collect():
        _, brackets, evidence = REVENUE[r.i]
        assert brackets is None or r.estimated_revenue in brackets, r
        assert all(e in r.revenue_evidence for e in evidence), r
        assert (r.estimated_revenue == "") == (r.estimated_employees == "") == (r.revenue_evidence == "")


def test_softmax_ties_go_to_the_lowest_bracket(spark):
    row = spark.range(1).select(revenue.softmax_top([F.lit(float(x)) for x in (1, 4, 4, 0, 4)]).alias("t")).first().t
    assert row.place == 1 and abs(row.share - 1 / (3 + 2.718281828 ** -1.5 + 2.718281828 ** -2)) < 1e-6


def test_joins(spark):
    base = spark.createDataFrame([("www.a.com", "1.1.1.1"), ("b.com", ""), ("c.com", "1.1.1.1")], "domain string, ip string")
    asn = spark.createDataFrame([("1.1.1.1", "X")], "bgp_ip string, bgp_asn_org string")
    assert {(r.domain, r.bgp_asn_org) for r in enrich.by_address(base, asn, F.col("ip")).collect()} == {("www.a.com", "X"), ("b.com", None), ("c.com", "X")}
    ranks = spark.createDataFrame([("a.com", 7)], "domain string, tranco_rank int")
    links = spark.createDataFrame([("b.com", 8, 9)], "domain string, majestic_rank int, majestic_ref_subnets int")
    bad = spark.createDataFrame([("c.com", "phishing")], "domain string, kind string")
    rows = {r.domain: (r.tranco_rank, r.majestic_rank, r.is_malware, r.is_phishing) for r in enrich.reputation(base, ranks, links, bad).collect()}
    assert rows == {"www.a.com": (7, None, "", ""), "b.com": (None, 8, "", ""), "c.com": (None, None, "", "true")}
    assert enrich.sized(base, 2) is base


def test_registry_domains(spark):
    rows = spark.createDataFrame([(x,) for x in ("uk.com", "www.ab.io", "stripe.com", "github.io", "a.b.com")], "d string")
    assert [r[0] for r in rows.select(enrich.registry_domain("d", ["github.io"])).collect()] == [True, True, False, True, False]


def test_assembled_row(spark):
    rows = spark.createDataFrame([("shop.fr", "google.com aspmx", "Shopify|React", 200), ("x.com", None, None, None)], "domain string, dns_mx string, http_tech string, http_status int")
    out = enrich.assemble(rows, "w1", F.lit(at(3)))
    assert [f.name for f in out.schema] == [f.name for f in row_schema()] and len(out.columns) == 55
    first, second = out.orderBy("domain").collect()
    assert first.http_tech == "Shopify|React|Google Workspace" and first.inferred_country == "FR" and first.worker == "w1" and first.business_model == "Ecommerce"
    assert second.http_status is None and second.dns_mx == "" and second.ctl_tld == "com" and second.estimated_revenue == ""
    assert enrich.sanitize(out.withColumn("http_title", F.lit("a\tb\\c"))).first().http_title == "a bc"


def test_second_tier_fills_and_overrules(spark):
    rows = spark.createDataFrame([("", 0.0, "SaaS", 0.4, 50), ("Blog", 0.4, "SaaS", 0.6, 50), ("Blog", 0.5, "SaaS", 0.6, 50), ("Blog", 0.6, "SaaS", 0.9, 50), ("", 0.0, "SaaS", 0.9, 5)], "a string, b double, c string, d double, n int")
    assert [r[0] for r in rows.select(classify.merge_tiers(*[F.col(x) for x in "abcdn"])).collect()] == ["SaaS", "SaaS", "Blog", "Blog", ""]
