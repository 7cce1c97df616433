"""Revenue bracket of a site from 25 signals, with the evidence for it; native Columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, values

#: Brackets in order, the letters used for them below, labels, midpoints and employee bands.
BRACKETS = "micro small mid_market enterprise large_enterprise".split()
LETTERS = "msiel"
REVENUE_LABELS = ["<$1M", "$1M-$10M", "$10M-$100M", "$100M-$1B", "$1B+"]
MIDPOINTS = [3e5, 3e6, 3e7, 3e8, 3e9]
EMPLOYEE_LABELS = ["1-10", "11-50", "51-500", "501-5000", "5001+"]
EMPLOYEE_BOUNDS = [10, 50, 500, 5000]
#: Revenue per employee by business model, and for any other.
PER_EMPLOYEE = {"SaaS": 200_000, "Ecommerce": 120_000, "Agency": 130_000, "Consulting": 150_000, "Media": 100_000, "Education": 40_000, "Marketplace": 150_000, "Newsletter": 200_000, "Community": 80_000, "Directory": 100_000, "Tool": 180_000}
OTHER_PER_EMPLOYEE = 120_000
LEAST_CONFIDENCE, LEAST_EVIDENCE, TEMPERATURE = 0.40, 3, 2.0

# A rule reads "condition => points => evidence"; points are a letter and a number each,
# and the evidence's bracket is the first point's letter unless another stands before it.
#: Ordered substring rules; the first that holds counts.
FIRST_MATCH = {
    ("registrar", "rdap_registrar"): """
markmonitor => l12 e6 => MarkMonitor
csc corporate, corporation service => l10 e5 => CSC
network solutions => e6 i3 => NetworkSolutions
godaddy => m4 s3 => GoDaddy
namecheap => m4 s3 => Namecheap
tucows => s3 m2 => Tucows
google, squarespace => s3 m2 => Google/Squarespace
cloudflare => s3 i2 => Cloudflare""",
    ("ssl_issuer", "ctl_issuer"): """
digicert => e10 l5 i3 => DigiCert
sectigo, comodo => i3 s2 => Sectigo
globalsign => e5 i3 => GlobalSign
entrust => e6 i2 => Entrust
let's encrypt, letsencrypt, r3, r10, r11 => m4 s3 => LetsEncrypt
amazon => s2 i2 => Amazon
google => s2 m1 => Google""",
    ("mx", "dns_mx"): """
=> m3 =>
pphosted, proofpoint => e12 l5 => Proofpoint
mimecast => e8 i4 => Mimecast
barracuda => i5 e4 => Barracuda
outlook, microsoft => i4 e3 s2 => Microsoft365
google, aspmx => s4 i2 m1 => GoogleWorkspace
zoho => s4 m2 => Zoho
secureserver.net, godaddy => m6 s2 => GoDaddy
registrar-servers => m5 s2 => Namecheap
emailsrvr.com, rackspace => i4 s2 => Rackspace
fastmail => s3 m2 => Fastmail""",
    ("cdn", "http_tech"): """
akamai => e8 l4 => Akamai
fastly => i4 e3 => Fastly
cloudfront => i3 s2 => CloudFront
imperva, incapsula => e6 i3 => Imperva""",
    ("cms", "http_tech"): """
sitecore => e15 l5 => Sitecore
adobe experience manager, aem => e15 l5 => AEM
drupal => i4 e2 => Drupal
shopify plus => i6 s2 => ShopifyPlus
shopify => s3 m2 => Shopify
wix => m8 s1 => Wix
squarespace => m6 s2 => Squarespace
webflow => s4 m2 => Webflow""",
    ("ns", "rdap_nameservers"): """
ultradns => e6 l3 => UltraDNS
dynect, dyn.com => e5 i3 => Dyn
nsone, ns1. => i4 e3 => NS1
awsdns => s3 i2 => Route53
cloudflare => s2 i1 => Cloudflare
domaincontrol, registrar-servers => m4 s1 => registrar_default
google => s2 m1 => Google""",
}
#: Independent substring rules; every one that holds counts.  Fields are joined by a plus sign.
EACH_MATCH = {
    "martech": [
        ("dns_txt+http_tech", "mktomail, marketo => e12 l5 i3 => martech:Marketo"),
        ("dns_txt+http_tech", "pardot => e10 i4 => martech:Pardot"),
        ("dns_txt+http_tech", "eloqua => l12 e6 => martech:Eloqua"),
        ("http_tech", "hubspot => s5 i4 => martech:HubSpot"),
        ("dns_txt+http_tech", "mcsv.net, mailchimp@http_tech => m4 s3 => martech:Mailchimp"),
        ("dns_txt+http_tech", "salesforce => i5 e4 => crm:Salesforce"),
    ],
    "pages": [
        ("http_pages", "/enterprise => i5 e3 => page:/enterprise"),
        ("http_pages", "/investors, /ir => e8 l4 => page:/investors"),
        ("http_pages", "/careers, /jobs => i4 s2 => page:/careers"),
        ("http_pages", "/security, /trust => i3 e2 => page:/security"),
        ("http_pages", "/partners, /partner-program => i3 e2 => page:/partners"),
    ],
    "txt": [("dns_txt", "onetrust, trustarc => e5 i3 => compliance:OneTrust/TrustArc"), ("dns_txt", "atlassian => i3 s2 => tools:Atlassian"), ("dns_txt", "docusign => i3 e2 => tools:DocuSign")],
    "tools": [
        ("http_tech", "adobe analytics => e10 l4 => tool:AdobeAnalytics"),
        ("http_tech", "segment => i3 s2 => tool:Segment"),
        ("http_tech", "intercom => s4 i3 => tool:Intercom"),
        ("http_tech", "zendesk => i4 s2 => tool:Zendesk"),
        ("http_tech", "amplitude, mixpanel => s3 i3 => tool:ProductAnalytics"),
        ("http_tech", "posthog, plausible => s3 m2 => tool:PrivacyAnalytics"),
        ("http_tech", "drift => i4 e3 => tool:Drift"),
    ],
}
#: Bounds of counts and ranks (<=: ranks, >=: counts), first that holds; evidence "#" is the number.
BOUNDS = {
    "tranco": "<=1000 => l20 e8 => top_1k:#; <=10000 => e15 l5 i3 => top_10k:#; <=100000 => i10 e4 s2 => top_100k:#; <=500000 => s6 i3 => top_500k:#; <=1000000 => s4 m2 => top_1m:#; else => m4 s2 => beyond_1m:#",
    "majestic": "<=5000 => l8 e4 => top_5k:#; <=50000 => e6 i3 => top_50k:#; <=500000 => i4 s2 => top_500k:#",
    "ref_subnets": ">=5000 => e5 => #; >=500 => i3 => #",
    "spf_includes": ">=9 => e8 l4 => #; >=6 => i5 e3 => #; >=3 => s4 i2 => #; >=1 => m2 s2 => #; else => m2 =>",
    "subdomains": ">=500 => l10 e5 => #; >=100 => e8 i3 => #; >=20 => i5 s2 => #; >=5 => s3 m1 => #; else => m2 =>",
    "tech_count": ">=25 => e8 i4 => #; >=15 => i5 e2 s1 => #; >=8 => s4 i2 => #; >=3 => s2 m2 => #; >=1 => m3 => #",
    "app_count": ">=10 => i4 s2 => #; >=5 => s3 i1 => #; >=2 => s2 m1 => #",
    "domain_age": ">=25 => e5 l3 => #yr; >=15 => i3 e2 => #yr; >=5 => s2 => #yr; <2 => m3 s1 => #yr",
    "dns_lb": ">=8 => e5 l2 => #_records; >=4 => i3 s1 => #_records; <=0 => m2 =>",
    "emails": ">=5 => i4 e2 => #; >=3 => s3 i1 => #",
}
#: Host names, name parts and labels.
SHARED_HOSTS = "godaddy bluehost hostgator hostinger namecheap dreamhost".split()
HOSTERS = (
    "amazon aws cloudflare google cloud digitalocean linode vultr hetzner ovh microsoft azure shopify squarespace wix godaddy bluehost hostgator hostinger dreamhost netlify vercel render railway heroku "
    "rackspace softlayer ibm oracle akamai fastly leaseweb"
).split()
INFRA_NAMES = "api staging dev app docs blog status support help admin portal dashboard cdn assets mail webmail vpn sso auth login jira confluence wiki gitlab jenkins ci cd monitor grafana sentry".split()
ENV_NAMES, API_NAMES, DOC_NAMES = "staging dev stg uat prod preprod".split(), "api api-v2 graphql grpc".split(), "docs developer developers".split()
INDUSTRY_PRIOR = "Finance => i3 e2 => Finance; Healthcare => i3 e2 => Healthcare; Government => i3 e2 => Government; Education => i2 s2 => Education; Real Estate => s2 i2 => RealEstate"

_NONE = "cast(null as struct<m:int,s:int,i:int,e:int,l:int,evidence:string>)"
_TEXTS = "rdap_registrar ctl_issuer dns_mx dns_txt http_tech http_pages rdap_nameservers bgp_asn_org http_schema_type http_title http_meta_description".split()
_COUNTS = "http_tech http_apps http_emails dns_a dns_aaaa".split()
_NUMBERS = "tranco_rank majestic_rank majestic_ref_subnets ctl_subdomain_count".split()


# Rules become SQL text over columns prepared once: one expression is parsed in place of thousands built by hand.
def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gain(signal: str, points: str, evidence: str | None) -> str:
    """Points by bracket and the evidence text; ``evidence`` is SQL, None for none."""
    amounts = {p[0]: int(p[1:]) for p in points.split()}
    bracket = BRACKETS[LETTERS.index(points.split()[0][0])]
    text = "cast(null as string)" if evidence is None else f"concat({_quote(signal + ':')}, {evidence}, {_quote('→' + bracket)})"
    return "named_struct(" + ", ".join(f"'{k}', {amounts.get(k, 0)}" for k in LETTERS) + f", 'evidence', {text})"


def _chain(steps: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {condition} then {gain}" for condition, gain in steps) + " end"


def _any(text: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {_quote(n)})" for n in needles) + ")"


def _parts(rule: str) -> tuple[str, str, str]:
    condition, points, evidence = (x.strip() for x in rule.split("=>"))
    return condition, points, evidence


def _by_text(signal: str, text: str, rules: str) -> str:
    steps = []
    for rule in filter(None, map(str.strip, rules.splitlines())):
        condition, points, evidence = _parts(rule)
        steps.append((_any(text, [x.strip() for x in condition.split(",")]) if condition else f"{text} = ''", _gain(signal, points, _quote(evidence) if evidence else None)))
    return _chain(steps)


def _by_number(signal: str, number: str, rules: str) -> str:
    steps = []
    for rule in rules.split(";"):
        condition, points, evidence = _parts(rule)
        before, mark, after = evidence.partition("#")
        text = None if not evidence else f"concat({_quote(before)}, cast({number} as string), {_quote(after)})" if mark else _quote(before)
        steps.append((f"{number} is not null" if condition == "else" else f"{number} {condition}", _gain(signal, points, text)))
    return _chain(steps)


def prepared(c, as_of_year: Column) -> dict[str, Column]:
    """Columns that rules read: lower-case texts, counts of values, whole numbers, the age in years; ``c`` gives a column by name, empty if missing."""
    number = lambda name: F.try_to_number(F.regexp_extract(filled(c(name).cast("string")), "^([0-9]{1,9})", 1), F.lit("999999999")).cast("int")
    year = F.try_to_number(F.regexp_extract(filled(c("rdap_domain_created_at").cast("string")), "^([0-9]{4})", 1), F.lit("9999")).cast("int")
    names = values(F.lower(filled(c("ctl_subdomains"))))
    exact, prefixes = F.array(*map(F.lit, INFRA_NAMES)), F.array(*[F.lit(n + "-") for n in INFRA_NAMES])
    return (
        {f"_t_{n}": F.lower(filled(c(n))) for n in _TEXTS}
        | {f"_c_{n}": F.size(values(c(n))) for n in _COUNTS}
        | {f"_n_{n}": number(n) for n in _NUMBERS}
        | {"_t_og": filled(c("http_og_type")), "_t_asn": filled(c("bgp_asn_number").cast("string")), "_t_industry": filled(c("industry")), "_age": as_of_year - year, "_names": names}
        | {"_infra": F.size(F.filter(names, lambda x: F.array_contains(exact, x) | F.exists(prefixes, lambda p: x.startswith(p))))}
    )


def signals() -> list[str]:
    """One gain for each signal over :func:`prepared`'s columns, in the order in which evidence is listed."""
    first = lambda key: _by_text(key[0], f"_t_{key[1]}", FIRST_MATCH[key])

    def each(name: str) -> list[str]:
        out = []
        for fields, rule in EACH_MATCH[name]:
            condition, points, evidence = _parts(rule)
            tests = []
            for x in map(str.strip, condition.split(",")):
                needle, _, only = x.partition("@")
                tests += [f"contains(_t_{f}, {_quote(needle)})" for f in ([only] if only else fields.split("+"))]
            signal, value = evidence.split(":", 1)
            out.append(_chain([(" or ".join(tests), _gain(signal, points, _quote(value)))]))
        return out

    among = lambda wanted: f"arrays_overlap(_names, array({', '.join(map(_quote, wanted))}))"
    short_org = "trim(left(split(_t_bgp_asn_org, ',')[0], 20))"
    infra = "concat(cast(_infra as string), '_infra')"
    headline = lambda *needles: " or ".join(_any(f"_t_{f}", list(needles)) for f in ("http_title", "http_meta_description"))
    return [
        f"coalesce({_by_number('tranco', '_n_tranco_rank', BOUNDS['tranco'])}, {_gain('tranco', 'm3', None)})",
        _by_number("majestic", "_n_majestic_rank", BOUNDS["majestic"]),
        _by_number("ref_subnets", "_n_majestic_ref_subnets", BOUNDS["ref_subnets"]),
        first(("registrar", "rdap_registrar")),
        first(("ssl_issuer", "ctl_issuer")),
        first(("mx", "dns_mx")),
        f"if(contains(_t_dns_txt, 'v=spf1'), {_by_number('spf_includes', chr(39).join(('regexp_count(_t_dns_txt, ', 'include:', ')')), BOUNDS['spf_includes'])}, {_gain('spf_includes', 'm2', None)})",
        _chain([("not contains(_t_dns_txt, 'v=dmarc1')", _gain("dmarc", "m2", None)), *[(f"contains(_t_dns_txt, 'p={p}')", _gain("dmarc", points, f"'p={p}'")) for p, points in (("reject", "i5 e4 l2"), ("quarantine", "s3 i3"), ("none", "s2 m1"))]]),
        *each("martech"),
        _by_number("subdomains", "_n_ctl_subdomain_count", BOUNDS["subdomains"]),
        _by_number("tech_count", "_c_http_tech", BOUNDS["tech_count"]),
        _by_number("app_count", "_c_http_apps", BOUNDS["app_count"]),
        first(("cdn", "http_tech")),
        first(("cms", "http_tech")),
        *each("pages"),
        _by_number("domain_age", "_age", BOUNDS["domain_age"]),
        _chain([("_t_bgp_asn_org = ''", _NONE), (_any("_t_bgp_asn_org", SHARED_HOSTS), _gain("hosting", "m6 s2", f"concat('shared:', {short_org})")), (f"not {_any('_t_bgp_asn_org', HOSTERS)} and _t_asn <> ''", _gain("hosting", "e6 l3", f"concat('own_asn:', {short_org})"))]),
        *each("txt"),
        *each("tools"),
        _chain([("_infra >= 8", _gain("subnames", "e8 l4", infra)), ("_infra >= 4", _gain("subnames", "i5 e3", infra)), (f"{among(ENV_NAMES)} and {among(API_NAMES)}", _gain("subnames", "i4 s2", "'env+api'")), (" or ".join(map(among, (ENV_NAMES, API_NAMES, DOC_NAMES))), _gain("subnames", "s3 i2", "'dev_env'"))]),
        first(("ns", "rdap_nameservers")),
        _by_number("dns_lb", "(_c_dns_a + _c_dns_aaaa)", BOUNDS["dns_lb"]),
        _chain([("_t_http_schema_type = ''", _NONE), ("contains(_t_http_schema_type, 'organization')", _gain("schema", "i3 e2", "'Organization'")), ("contains(_t_http_schema_type, 'product')", _gain("schema", "s2 i1", "'Product'")), ("true", _gain("schema", "s1", "_t_http_schema_type"))]),
        _chain([("_t_og <> ''", _gain("og", "s1", None))]),
        _chain([(headline("enterprise", "fortune 500"), _gain("title", "e4 i2", "'enterprise_lang'"))]),
        _chain([(f"({headline('platform')}) and ({headline('leading', 'global')})", _gain("title", "i3 e2", "'platform_leader'"))]),
        _chain([(headline("free website", "my blog", "personal site"), _gain("title", "m4 s1", "'personal'"))]),
        _by_number("emails", "_c_http_emails", BOUNDS["emails"]),
        _chain([(f"_t_industry = {_quote(name)}", _gain("industry", points, _quote(evidence))) for name, points, evidence in map(_parts, INDUSTRY_PRIOR.split(";"))]),
    ]


def _sum(items: str, field: str) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x[field])


def softmax_top(scores: list[Column], temperature: float = TEMPERATURE) -> Column:
    """``struct(place, share)``: the greatest score's place (ties to the first) and its softmax share."""
    best = F.greatest(*scores)
    total = reduce(lambda a, b: a + b, [F.exp((s - best) / F.lit(temperature)) for s in scores])
    place = reduce(lambda other, i: F.when(scores[i] == best, F.lit(i)).otherwise(other), reversed(range(len(scores))), F.lit(None).cast("int"))
    return F.struct(place.alias("place"), (F.lit(1.0) / total).alias("share"))


def employees(place: Column, business_model: Column) -> Column:
    """The staff band of a bracket's midpoint over the model's revenue per employee."""
    midpoint = F.element_at(F.array(*map(F.lit, MIDPOINTS)), place + 1)
    per = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PER_EMPLOYEE.items() for x in kv]), filled(business_model)), F.lit(OTHER_PER_EMPLOYEE))
    staff = midpoint / per
    found = F.when(staff <= EMPLOYEE_BOUNDS[0], EMPLOYEE_LABELS[0])
    for bound, label in zip(EMPLOYEE_BOUNDS[1:], EMPLOYEE_LABELS[1:]):
        found = found.when(staff <= bound, label)
    return found.otherwise(EMPLOYEE_LABELS[-1])


def estimate(sites: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Add ``estimated_revenue, estimated_employees, revenue_confidence, revenue_evidence``; empty without a status, evidence or confidence."""
    have = set(sites.columns)
    column = lambda name: F.col(name) if name in have else F.lit("")
    year = F.year(F.current_date()) if as_of_year is None else F.lit(as_of_year)
    ready = prepared(column, year)
    gained = sites.withColumns(ready).withColumn("_g", F.expr(f"array_compact(array({', '.join(signals())}))"))
    scored = gained.withColumns({f"_{k}": _sum("_g", k) for k in LETTERS} | {"_ev": F.array_compact(F.transform("_g", lambda x: x["evidence"]))})
    top = scored.withColumn("_top", softmax_top([F.col(f"_{k}").cast("double") for k in LETTERS]))
    conf = F.least(F.round(F.col("_top.share") * 0.7 + F.least(F.size("_ev") / 10.0, F.lit(1.0)) * 0.3, 2), F.lit(0.99))
    total = reduce(lambda a, b: a + b, [F.col(f"_{k}") for k in LETTERS])
    status = filled(column("http_status").cast("string")) != ""
    top = top.withColumn("_conf", conf).withColumn("_ok", status & (total > 0) & (F.size("_ev") >= LEAST_EVIDENCE) & (F.col("_conf") >= LEAST_CONFIDENCE))
    place = F.col("_top.place")
    out = top.withColumns(
        {
            "estimated_revenue": F.when(F.col("_ok"), F.element_at(F.array(*map(F.lit, REVENUE_LABELS)), place + 1)).otherwise(""),
            "estimated_employees": F.when(F.col("_ok"), employees(place, column("business_model"))).otherwise(""),
            "revenue_confidence": F.when(F.col("_ok"), F.col("_conf")).otherwise(0.0),
            "revenue_evidence": F.when(F.col("_ok"), F.array_join("_ev", "|")).otherwise(""),
        }
    )
    return out.drop("_g", "_ev", "_top", "_conf", "_ok", *[f"_{k}" for k in LETTERS], *ready)
