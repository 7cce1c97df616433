"""The classifier one signal at a time, and the revenue model on whole sites."""

import pytest

from quarry.operators import classify, revenue

#: Input, its text, and the model and industry that it alone decides (None: not looked at).
ONE_SIGNAL = [
    ("http_tech", "Shopify|React", "Ecommerce", None), ("http_tech", "WordPress|WooCommerce", "Ecommerce", None), ("http_tech", "PHP|Magento", "Ecommerce", None), ("http_tech", "BigCommerce", "Ecommerce", None),
    ("http_tech", "Substack", "Newsletter", None), ("http_tech", "Ghost", "Media", None), ("http_tech", "Discourse", "Community", None), ("http_apps", "LearnDash", "Education", None), ("http_apps", "BuddyPress", "Community", None),
    ("http_tech", "Shopify Plus", "", None), ("http_tech", "shopify", "", None),
    ("http_schema_type", "SoftwareApplication", "SaaS", None), ("http_schema_type", "Product", "Ecommerce", None), ("http_schema_type", "Restaurant", None, "Food & Beverage"), ("http_schema_type", "Dentist", None, "Healthcare"),
    ("http_schema_type", "LegalService", "Consulting", "Legal"), ("http_schema_type", "ClothingStore", "Ecommerce", "Fashion"), ("http_schema_type", "FurnitureStore", "Ecommerce", "Home & Garden"), ("http_schema_type", "CollegeOrUniversity", "Education", "Education"),
    ("http_og_type", "product", "Ecommerce", None), ("http_og_type", "article", "Media", None),
    ("http_pages", "/pricing|/login|/docs", "SaaS", None), ("http_pages", "/pricing|/login", "SaaS", None), ("http_pages", "/pricing|/free-trial", "SaaS", None), ("http_pages", "/cart|/products", "Ecommerce", None), ("http_pages", "/portfolio|/case-studies", "Agency", None),
    ("http_pages", "/courses|/enroll", "Education", None), ("http_pages", "/directory|/submit-listing", "Directory", None),
    ("nav_links", "Shop Products Sale", "Ecommerce", None), ("nav_links", "Pricing Docs Login", "SaaS", None), ("nav_links", "Portfolio Our Work", "Agency", None), ("nav_links", "Our Menu Reservations", None, "Food & Beverage"),
    ("ctl_tld", "edu", None, "Education"), ("ctl_tld", "law", None, "Legal"), ("ctl_tld", "dental", None, "Healthcare"), ("ctl_tld", "bank", None, "Fintech"), ("ctl_tld", "restaurant", None, "Food & Beverage"), ("ctl_tld", "ai", None, "AI & ML"),
    ("ctl_tld", "travel", None, "Travel"), ("ctl_tld", "construction", None, "Construction & Manufacturing"), ("ctl_tld", "com", "", ""),
    ("http_title", "Cloud-based SaaS for projects", "SaaS", None), ("http_title", "Shop now, free shipping", "Ecommerce", None), ("http_title", "A full-service digital agency", "Agency", None), ("http_title", "The newsletter, a weekly digest", "Newsletter", None),
    ("http_title", "Marketplace to buy and sell", "Marketplace", None), ("http_title", "Fintech payment gateway", None, "Fintech"), ("http_title", "HIPAA telemedicine", None, "Healthcare"), ("http_title", "SEO and email marketing", None, "Marketing"),
    ("http_title", "Personal injury law firm", None, "Legal"), ("http_title", "Homes for sale", None, "Real Estate"), ("http_title", "AI-powered LLM", None, "AI & ML"), ("http_title", "Developer tools, SDK", None, "DevTools"), ("http_title", "Skincare and cosmetics", None, "Beauty"),
    ("body_text", "skincare serum and beauty", None, "Beauty"), ("dns_txt", "shopify-verification=1", "", None),
]


def test_one_signal_decides(spark):
    rows = spark.createDataFrame([(i, *(text if n == name else "" for n in classify.INPUTS)) for i, (name, text, _, _) in enumerate(ONE_SIGNAL)], "i int, " + ", ".join(f"{n} string" for n in classify.INPUTS))
    for r in classify.classify(rows).collect():
        _, _, model, industry = ONE_SIGNAL[r.i]
        assert model is None or r.business_model == model, (ONE_SIGNAL[r.i], r)
        assert industry is None or r.industry == industry, (ONE_SIGNAL[r.i], r)


def test_body_text_counts_half(spark):
    names = ", ".join(f"{n} string" for n in classify.INPUTS)
    site = lambda **v: tuple(v.get(n, "") for n in classify.INPUTS)
    title, body = (classify.classify(spark.createDataFrame([site(**{name: "cloud-based saas platform"})], names)).first() for name in ("http_title", "body_text"))
    assert title.business_model == "SaaS" and title.classification_confidence > body.classification_confidence


SITES = [
    (dict(tranco_rank="300", rdap_registrar="MarkMonitor, Inc.", ctl_issuer="DigiCert Inc", dns_mx="mx1.pphosted.com", dns_txt="v=spf1 include:mktomail.com include:_spf.salesforce.com include:c include:d include:e ~all v=DMARC1; p=reject", http_tech="Akamai|React|Segment|Zendesk",
          http_pages="/enterprise|/careers|/security|/partners", ctl_subdomain_count="350", rdap_domain_created_at="1998-09-15", bgp_asn_org="PAYMENTS, INC.", bgp_asn_number="AS1"), {"$100M-$1B", "$1B+"}, {"501-5000", "5001+"}, 0.7, ["tranco", "registrar:MarkMonitor"]),
    (dict(rdap_registrar="GoDaddy.com, LLC", ctl_issuer="R3", dns_mx="aspmx.l.google.com", dns_txt="v=spf1 include:_spf.google.com ~all", http_tech="Shopify|jQuery", http_apps="Klaviyo|Judge.me|Afterpay", http_pages="/cart|/collections", ctl_subdomain_count="2",
          rdap_domain_created_at="2020-06-01", business_model="Ecommerce", industry="Fashion"), {"<$1M", "$1M-$10M"}, None, 0.4, ["app_count:3"]),
    (dict(rdap_registrar="Namecheap, Inc.", ctl_issuer="R3", dns_mx="registrar-servers.com", http_tech="WordPress", http_pages="/about", ctl_subdomain_count="1", rdap_domain_created_at="2023-08-20", bgp_asn_org="NAMECHEAP-NET"), {"<$1M"}, {"1-10"}, 0.4, ["hosting:shared:namecheap-net"]),
    (dict(tranco_rank="2000", rdap_registrar="MarkMonitor, Inc.", dns_mx="outlook.protection.com", dns_txt="v=spf1 include:a include:b include:c ~all"), {"$100M-$1B", "$1B+"}, None, 0.4, ["spf_includes:3"]),
    (dict(rdap_nameservers="a.domaincontrol.com", rdap_registrar="GoDaddy.com, LLC", ctl_issuer="R3", dns_mx="secureserver.net"), {"<$1M"}, None, 0.4, ["ns:registrar_default"]),
    (dict(dns_txt="v=spf1 include:servers.mcsv.net ~all", dns_mx="aspmx.l.google.com", ctl_issuer="R3", rdap_registrar="GoDaddy.com, LLC"), {"<$1M"}, None, 0.4, ["martech:Mailchimp"]),
    (dict(tranco_rank="30000", dns_a="|".join(f"{i}.0.0.1" for i in range(8)), rdap_registrar="MarkMonitor, Inc.", dns_mx="pphosted.com"), {"$100M-$1B", "$1B+"}, None, 0.4, ["dns_lb:8_records"]),
    (dict(industry="Finance", tranco_rank="200000", dns_mx="outlook.protection.com", ctl_issuer="DigiCert Inc", dns_txt="v=spf1 include:a include:b include:c ~all v=DMARC1; p=reject"), None, None, 0.4, ["industry:Finance", "dmarc:p=reject"]),
]


@pytest.fixture(scope="module")
def estimates(spark):
    names = sorted({k for site in SITES for k in site[0]})
    rows = spark.createDataFrame([(i, "200", *(site[0].get(n, "") for n in names)) for i, site in enumerate(SITES)], "i int, http_status string, " + ", ".join(f"{n} string" for n in names))
    return {r.i: r for r in revenue.estimate(rows, 2024).collect()}


@pytest.mark.parametrize("i", range(len(SITES)))
def test_revenue_of_whole_sites(estimates, i):
    _, brackets, staff, least, evidence = SITES[i]
    r = estimates[i]
    assert (brackets is None or r.estimated_revenue in brackets) and (staff is None or r.estimated_employees in staff), r
    assert least <= r.revenue_confidence <= 0.99 and all(e in r.revenue_evidence for e in evidence), r
    assert all("→" in item for item in r.revenue_evidence.split("|"))
