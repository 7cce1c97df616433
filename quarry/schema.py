"""Schemas: the 55-column observation row and the inputs around it."""

from __future__ import annotations

from pyspark.sql import types as T

#: The row's columns in contractual order, with their types.
ROW_DDL = (
    "enriched_at timestamp, worker string, domain string, "
    "ctl_tld string, ctl_issuer string, ctl_subdomain_count int, ctl_subdomains string, "
    "dns_a string, dns_aaaa string, dns_mx string, dns_txt string, dns_cname string, "
    "http_status int, http_response_time int, http_blocked string, http_content_type string, http_tech string, http_apps string, http_language string, http_title string, "
    "http_meta_description string, http_pages string, http_emails string, http_error string, http_h1 string, http_body_snippet string, "
    "business_model string, industry string, classification_confidence float, http_schema_type string, http_og_type string, "
    "bgp_ip string, bgp_asn_number string, bgp_asn_org string, bgp_asn_country string, bgp_asn_prefix string, "
    "inferred_country string, "
    "rdap_domain_created_at timestamp, rdap_domain_expires_at timestamp, rdap_domain_updated_at timestamp, rdap_registrar string, rdap_registrar_iana_id string, rdap_nameservers string, rdap_status string, rdap_error string, "
    "tranco_rank int, majestic_rank int, majestic_ref_subnets int, is_malware string, is_phishing string, is_disposable_email string, "
    "estimated_revenue string, estimated_employees string, revenue_confidence float, revenue_evidence string"
)
#: Columns that hold several values joined by a pipe.
MULTI_VALUE = (
    "ctl_subdomains", "dns_a", "dns_aaaa", "dns_mx", "dns_txt", "dns_cname", "http_tech", "http_apps", "http_pages", "http_emails", "rdap_nameservers", "rdap_status", "revenue_evidence",
)
#: What the detail view and the export list, in order.
DETAIL_COLUMNS = tuple(
    "domain http_title http_tech http_apps http_status http_response_time http_language http_emails http_content_type http_meta_description http_h1 http_schema_type http_og_type http_pages "
    "bgp_ip bgp_asn_number bgp_asn_org bgp_asn_country bgp_asn_prefix dns_a dns_aaaa dns_mx dns_txt dns_cname rdap_registrar rdap_registrar_iana_id rdap_nameservers rdap_domain_created_at "
    "rdap_domain_expires_at rdap_domain_updated_at rdap_status ctl_tld ctl_issuer ctl_subdomains ctl_subdomain_count tranco_rank majestic_rank majestic_ref_subnets business_model industry "
    "classification_confidence estimated_revenue estimated_employees revenue_confidence revenue_evidence is_malware is_phishing is_disposable_email enriched_at".split()
)
#: What the explorer lists, in order; the country follows them.
LIST_COLUMNS = tuple("domain http_title http_tech http_apps business_model industry estimated_revenue estimated_employees http_language enriched_at tranco_rank majestic_rank http_response_time".split())

CERT_DDL = "ctl_domain string, ctl_tld string, ctl_issuer string, ctl_subdomain_count int, ctl_subdomains string"


def row_schema() -> T.StructType:
    """The observation row as a schema; missing strings are empty, never null."""
    types = {"string": T.StringType(), "int": T.IntegerType(), "float": T.FloatType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in (x.split() for x in ROW_DDL.split(","))])
