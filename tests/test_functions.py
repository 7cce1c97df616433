"""Column functions on hand-made rows."""

import base64

import pytest
from pyspark.sql import functions as F

from quarry.functions import domains, html, schema_org, text
from quarry.operators import detect, grades
from quarry.schema import MULTI_VALUE, row_schema
from quarry.sources import readers, sinks


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def run(spark, column, value, kind="string"):
    return one(spark, value, kind).select(column.alias("y")).first().y


def test_row_has_55_columns():
    names = [f.name for f in row_schema()]
    assert len(names) == 55 and len(set(names)) == 55 and set(MULTI_VALUE) <= set(names)


@pytest.mark.parametrize(
    ("name", "base", "tld", "sub", "depth"),
    [("*.Shop.Example.co.uk", "example.co.uk", "co.uk", "shop", 1), ("a.b.example.com", "example.com", "com", "a|b", 2), ("co.uk", "co.uk", "uk", "", 0), ("example.io", "example.io", "io", "", 0)],
)
def test_parse_domain(spark, name, base, tld, sub, depth):
    assert tuple(run(spark, domains.parse_domain("x"), name)) == (base, tld, sub, depth)


def test_parse_domain_of_one_label(spark):
    assert run(spark, domains.parse_domain("x"), "localhost") is None


@pytest.mark.parametrize(
    ("tld", "lang", "rdap", "bgp", "want"),
    [("fr", "", None, "", "FR"), ("co.uk", "ja", None, "JP", "GB"), ("io", "", None, "", "US"), ("com", "fr-CA", None, "", "FR"), ("com", "sco", None, "", "GB"), ("com", "en", None, "", "US"), ("com", "", "DE", "", "DE"), ("com", "de", "US", "", "DE"), ("xyz", "", None, "DE", "DE"), (None, None, None, None, "US"), (" FR ", "", "", "", "FR"), ("co.zw", "", "", "", "ZW")],
)
def test_infer_country(spark, tld, lang, rdap, bgp, want):
    row = spark.createDataFrame([(tld, lang, rdap, bgp)], "a string, b string, c string, d string")
    assert row.select(domains.infer_country("a", "b", "c", "d")).first()[0] == want


@pytest.mark.parametrize(
    ("stored", "tld", "lang", "bgp", "ip", "want"),
    [("XX", "fr", "de", "", "", "XX"), ("", "fr", "de", "", "", "FR"), ("", "co.zw", "", "DE", "", "DE"), ("", "com", "fr-CA", "DE", "", "DE"), ("", "com", "en", "DE", "", "US"), ("", "com", "", "CA", "23.227.38.1", "US"), ("", "com", "", "CA", "1.1.1.1", "CA"), ("", "com", "bn", "", "", "US")],
)
def test_query_time_country(spark, stored, tld, lang, bgp, ip, want):
    row = spark.createDataFrame([(stored, tld, lang, bgp, ip)], "a string, b string, c string, d string, e string")
    assert row.select(domains.country("a", "b", "c", "d", "e")).first()[0] == want


def test_crawl_gate(spark):
    rows = spark.createDataFrame([("example.com", "10:mx", "v=spf1"), ("business.co.uk", "10:mx", "v=spf1"), ("example.com", "", "v=spf1"), ("example.com", "10:mx", ""), ("aa.io", "10:mx", "v=spf1"), ("ab12cd.com", "10:mx", "v=spf1"), ("my-own-shop.com", "10:mx", "v=spf1")], "d string, m string, t string")
    assert [r[0] for r in rows.select(domains.crawl_gate("d", "m", "t", ["com", "io", "co.uk"])).collect()] == [True, True, False, False, False, False, False]


def test_names(spark):
    assert run(spark, domains.strip_www("x"), "WWW.www.Example.com") == "example.com"
    assert run(spark, domains.lookup_name("x"), " HTTPS://Example.com/a/b ") == "example.com"
    assert run(spark, text.slug("x"), " Judge.me & Co ") == "judge-me-co"
    assert run(spark, domains.suffix_match("x", ["github.io"]), "notgithub.io") is True
    assert run(spark, domains.suffix_match("x", ["github.io"], True), "notgithub.io") is False


def test_text(spark):
    assert run(spark, text.repair("x"), 'a\\b\tc\nd\re\x01' + "f" * 3000) == "ab c de" + "f" * 1993
    assert run(spark, text.values("x"), "a||b|") == ["a", "b"]
    assert run(spark, text.csv_field("x"), 'say "hi", all') == '"say ""hi"", all"'
    assert [run(spark, text.has_value("x"), v) for v in ("a", "", "0", None)] == [True, False, False, False]


PAGE = (
    '<html lang="fr-CA"><head><title> My &amp; page </title><meta content="What it is" name="description"><meta property="og:type" content=" Product "></head><body><header><a href="/x">Hdr</a></header>'
    "<h1>A <b>big</b>\n head</h1><script>var p = 1;</script><style>p{}</style><p>Text&nbsp;here</p>"
    '<a href="/Pricing?x=1#y">P</a><a href="about/">A</a><a href="https://www.shop.com/contact/us/">C</a><a href="https://else.org/z">E</a><a href="mailto:Sales@Company.com">M</a><a href="#top">T</a><a href="//cdn/x">N</a></body></html>'
)


def test_html_parts(spark):
    got = one(spark, PAGE).select(html.title("x"), html.h1("x"), html.meta_description("x"), html.nav_text("x"), html.visible_text("x"), html.og_type("x"), html.html_language("x")).first()
    assert tuple(got) == ("My &amp; page", "A big head", "What it is", "Hdr", "My & page Hdr A big head Text here P A C E M T N".replace("My & page", "My page"), "product", "fr-ca")
    assert tuple(one(spark, None).select(html.title("x"), html.h1("x"), html.nav_text("x"), html.visible_text("x")).first()) == ("", "", "", "")


def test_page_paths(spark):
    assert run(spark, html.page_paths("x", F.lit("shop.com"), None, []), PAGE) == ["/x", "/pricing", "/about", "/contact/us"]
    assert run(spark, html.page_paths("x", F.lit("shop.com"), ["/contact", "/pricing"], [["/contact/us"], ["/pricing"]]), PAGE) == ["/contact/us", "/pricing"]
    assert run(spark, html.page_paths("x", F.lit("shop.com")), PAGE) == ["/pricing", "/contact/us"]


def hide(address, key=0x42):
    return bytes([key, *(ord(c) ^ key for c in address)]).hex()


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("write to sales@company.com or Sales@Company.com", ["sales@company.com"]),
        ('<a href="mailto:Contact@Company.com">', ["contact@company.com"]),
        ('<a href="mailto:info%40shop.io?subject=x">', ["info@shop.io"]),
        ('<div data-email="help@shop.dev">', ["help@shop.dev"]),
        ("sales [@] shop [.] io and help AT shop DOT org", ["sales@shop.io", "help@shop.org"]),
        ("sales @ shop . net or info {at} shop {dot} us", ["sales@shop.net", "info@shop.us"]),
        ("team&#64;shop&#46;io x", ["team@shop.io"]),
        ("'me' + '@' + 'shop.app'", ["me@shop.app"]),
        ('<span data-reverse="1">moc.pohs@ofni</span>', ["info@shop.com"]),
        ("moc.pohs@ofni", []),
        (f'<a data-cfemail="{hide("sales@shop.com")}">', ["sales@shop.com"]),
        (f'<a data-cfemail="{hide("example@shop.com")}">', []),
        ("noreply@shop.io x@sentry.io logo@2x.png admin@shop.com abuse@shop.com x@y.wixsite.com a@example.org a@b.zz", []),
        ("<body>in@shop.com " + "é" * 60_000 + " out@shop.com", ["in@shop.com"]),
        ("<head>out@head.com</head><body>in@body.com</body>", ["in@body.com"]),
        (" ".join(f"a{i}@shop.com" for i in range(15)), [f"a{i}@shop.com" for i in range(10)]),
        (None, []),
    ],
)
def test_emails(spark, body, want):
    assert run(spark, html.emails("x"), body) == want


def test_hidden_address(spark):
    assert run(spark, html.unhide_email("x"), hide("example@example.com")) == "example@example.com"
    assert run(spark, html.unhide_email("x"), "zz") is None


def test_schema_types(spark):
    doc = lambda x: f'<script type="application/ld+json">{x}</script>'
    cases = [(doc('{"@graph":[{"@type":"WebSite"},{"@type":["Organization","Dentist"]}]}'), "Dentist"), (doc("{bad") + doc('[{"@type":"Store"}]'), "Store"), ("<p>", ""), (None, "")]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "x string")
    assert [r[0] for r in rows.select(schema_org.schema_type("x")).collect()] == [w for _, w in cases]


def test_detect_tech(spark):
    body = '<script src="https://unpkg.com/react@18/x.js"></script><script src="https://cdn.jsdelivr.net/npm/vue@3"></script><script src="https://www.googletagmanager.com/gtag/js?id=1"></script><meta name="generator" content="WordPress 6">'
    rows = spark.createDataFrame([(body, {"server": "nginx/1.2", "cf-ray": "1"}), ("", {}), (None, None)], "body string, headers map<string,string>")
    out = [r.tech for r in detect.detect_tech(rows).orderBy(F.desc(F.length("body"))).collect()]
    assert {"React", "Vue.js", "Google Analytics", "WordPress", "Nginx", "Cloudflare", "unpkg", "jsDelivr"} <= set(out[0]) and out[0] == sorted(out[0]) and out[1] == [] and out[2] == []
    flags = rows.limit(1).select(detect.cdn("headers"), detect.blocked("body", "headers"), detect.script_site("body")).first()
    assert tuple(flags) == ("cloudflare", "", False)


def test_detect_apps(spark):
    body = '<script src="https://cdn.judge.me/x.js"></script><link href="/wp-content/plugins/elementor/x.css"><div class="wpcf7">'
    assert run(spark, detect.detect_apps("x"), body) == ["Contact Form 7", "Elementor", "Judge.me"]


def test_grades(spark):
    spf = lambda v: run(spark, grades.spf_grade("x"), v)
    assert [spf(v) for v in ("v=spf1 include:a include:b include:c -all", "x|v=spf1 include:a include:b ~all", "v=spf1 include:a ~all", "v=spf1 include:a", "none")] == ["gold", "gold", "silver", "bronze", None]
    assert run(spark, grades.dmarc_grade("x"), "v=DMARC1; p=reject") == "gold" and run(spark, grades.dmarc_grade("x"), "k=rsa; p=x") == "silver"
    assert run(spark, grades.mail_provider("x"), "10:aspmx.l.google.com|20:outlook") == "Google Workspace"
    assert run(spark, grades.dns_provider("x"), "ns1.unknown-host.net|ns2") == "unknown-host.net"
    age = lambda d: run(spark, F.concat_ws("/", grades.age_short(F.to_date("x"), F.lit("2024-03-01").cast("date")), grades.age_long(F.to_date("x"), F.lit("2024-03-01").cast("date"))), d)
    assert [age(d) for d in ("2024-02-20", "2023-10-01", "2020-01-01")] == ["10d/10 days", "5m/5 months", "4y/4y 2m"]


def test_slug_routes(spark):
    got = [tuple(run(spark, grades.route("x"), s)) for s in ("shopify-stores-using-klaviyo-in-us", "shopify-stores-using-klaviyo", "shopify-stores-us", "klaviyo-vs-mailchimp")]
    assert got == [("tech_in_country", "Klaviyo", "US"), ("tech", "Klaviyo", ""), ("country", "", "US"), ("compare", "klaviyo|mailchimp", "")]
    assert run(spark, grades.route("x"), "shopify-stores-in-us") is None


def test_rank_lists(spark):
    lines = lambda *x: spark.createDataFrame([(v, i) for i, v in enumerate(x)], "value string, line long")
    assert sorted(map(tuple, readers.ranks(lines("1,google.com", "", "badline", "7, WWW.Shop.com ", "9,shop.com")).collect())) == [("google.com", 1), ("shop.com", 9)]
    rows = readers.link_ranks(lines("GlobalRank,TldRank,Domain,TLD,RefSubNets,RefIPs", "1,1,google.com,com,245000,380000,,,,,,")).collect()
    assert [tuple(r) for r in rows] == [("google.com", 1, 245000)]


def test_blocklists(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    out = readers.blocklist({"malware": lines("0.0.0.0 malware1.com", "# c", "0.0.0.0 localhost"), "phishing": lines("bad.org", "malware1.com", "! x"), "disposable": lines("bad.org", "temp.io")})
    assert {tuple(r) for r in out.collect()} == {("malware1.com", "malware"), ("bad.org", "phishing"), ("temp.io", "disposable")}


def test_whois_and_rdap(spark):
    text_rows = spark.createDataFrame([("13335 | 1.1.1.1 | 1.1.1.0/24 | US | arin | 2010-07-14 | CLOUDFLARE | NET, US",), ("AS | IP",)], "value string")
    assert [tuple(r) for r in readers.whois(text_rows).collect()] == [("1.1.1.1", "13335", "CLOUDFLARE | NET, US", "US", "1.1.1.0/24")]
    doc = '{"ldhName":"X.COM","status":["active"],"events":[{"eventAction":"registration","eventDate":"2001-02-03T04:05:06Z"}],"nameservers":[{"ldhName":"NS1.X.COM"}],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Good Names"]]],"publicIds":[{"type":"IANA","identifier":"42"}]}]}'
    row = readers.rdap(spark.createDataFrame([("x.com", doc)], "domain string, body string")).first()
    assert str(row.rdap_domain_created_at) == "2001-02-03 04:05:06" and (row.rdap_registrar, row.rdap_registrar_iana_id, row.rdap_nameservers, row.rdap_status, row.rdap_error) == ("Good Names", "42", "ns1.x.com", "active", "")
    assert readers.rdap(spark.createDataFrame([("x.com", "no json")], "domain string, body string")).first().rdap_error == "unreadable"
    servers = run(spark, readers.rdap_servers("x"), '{"services":[[["com","NET"],["https://a/"]],[["org"],["https://b/","https://c/"]]]}')
    assert [tuple(s) for s in servers] == [("com", "https://a/"), ("net", "https://a/"), ("org", "https://b/")]


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def certificate(subject, issuer, names):
    name = lambda cn: der(0x30, der(0x31, der(0x30, der(0x06, b"\x55\x04\x03"), der(0x0C, cn.encode())))) if cn else der(0x30)
    alt = der(0x30, *[der(0x82, n.encode()) for n in names])
    extensions = der(0xA3, der(0x30, der(0x30, der(0x06, b"\x55\x1d\x11"), der(0x04, alt))))
    body = der(0x30, der(0xA0, der(0x02, b"\x02")), der(0x02, b"\x01"), der(0x30), name(issuer), der(0x30), name(subject), der(0x30), extensions)
    return der(0x30, body, der(0x30), der(0x03, b"\x00"))


def leaf(kind, data):
    return base64.b64encode(b"\0\0" + bytes(8) + kind.to_bytes(2, "big") + len(data).to_bytes(3, "big") + data).decode()


def test_certificates(spark):
    rows = [leaf(0, certificate("*.a.shop.co.uk", "R3", ["x.y"])), leaf(0, certificate("", "", ["www.example.com"])), leaf(1, b"x"), leaf(0, b"junk"), "!!"]
    out = readers.certificates(spark.createDataFrame([(r,) for r in rows], "leaf_input string")).collect()
    assert sorted(tuple(r) for r in out) == [("example.com", "com", "Unknown", 1, "www"), ("shop.co.uk", "co.uk", "R3", 1, "a")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", None, 3)], "x string, y string, z int")
    assert sinks.csv_lines(rows).first().line == '"a,b",,3'
    assert sinks.sitemap_xml(spark.createDataFrame([("https://x/?a&b",)], "loc string")).first().xml == "<url><loc>https://x/?a&amp;b</loc></url>"
    assert rows.select(sinks.to_json(["x", "y"])).first()[0] == '{"x":"a,b"}'
    sinks.write_csv(rows, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).first().x == "a,b"


def test_shipped_lists(spark):
    from quarry.operators import enrich
    from quarry.rules import lists

    assert (len(lists.SHARED_HOSTS), len(lists.HIGH_VALUE_TLDS), len(lists.REGISTRIES)) == (73, 41, 117) or all(len(x) == len(set(x)) for x in (lists.SHARED_HOSTS, lists.HIGH_VALUE_TLDS, lists.REGISTRIES))
    shared = lambda d: run(spark, enrich.on_shared_host("x"), d)
    assert [shared(d) for d in ("shop.github.io", "github.io", "notgithub.io", "mycompany.com", "x.launchdarkly.com")] == [True, True, True, False, True]
    registry = lambda d: run(spark, enrich.registry_domain("x"), d)
    assert [registry(d) for d in ("uk.com", "www.uk.com", "ab.io", "abc.io", "x.uk.com", "herokuapp.com")] == [True, True, True, False, False, True]


def test_shown_values(spark):
    from quarry.functions import format

    one_of = lambda c, v, kind="string": run(spark, c, v, kind)
    assert [one_of(format.rank("x"), v, "int") for v in (None, 0, 5, 1234567)] == [None, None, "#5", "#1,234,567"]
    assert [one_of(format.date("x"), v) for v in ("2024-01-05T10:00:00Z", "", None, "soon")] == ["Jan 05, 2024", None, None, "soon"]
    assert [one_of(format.moment("x"), v) for v in ("2024-01-05T10:20:00Z", None, "soon")] == ["Jan 05, 2024 10:20 UTC", "—", "soon"]
    assert [one_of(format.percent("x"), v, "double") for v in (0.875, None)] == ["88%", None]
    assert [one_of(format.content_type("x"), v) for v in ("TEXT/HTML; a", "font/woff; b", "", None)] == ["HTML", "font/woff", None, None]
    assert [one_of(format.flag("x"), v) for v in ("de", "", "DEU", None)] == ["\U0001f1e9\U0001f1ea", "", "", ""]
    assert [one_of(format.language_flag("x"), v) for v in ("EN-us", "xx", None)] == ["\U0001f1ec\U0001f1e7", "", ""]


def test_character_references(spark):
    assert run(spark, html.unescape("x"), "&lt;a&gt; &amp;amp; &#233;&#8364;&#128512;&#0065;&#55296;&#999999999999; &unknown;") == "<a> &amp; é€\U0001f600A &unknown;"
    assert run(spark, html.unescape("x"), None) is None and run(spark, html.unescape("x"), "") == ""


def test_invalid_bytes_end_a_value(spark):
    raw = spark.createDataFrame([(bytearray(b"good \xc3\xa9 part\xff rest"),), (bytearray("whole \ufffd text".encode()),)], "x binary").select(F.col("x").cast("string").alias("x"))
    assert [r.y for r in raw.select(text.repair("x").alias("y")).collect()] == ["good é part", "whole \ufffd text"]


def test_rule_lines(spark):
    rows = spark.createDataFrame([(v,) for v in ("# c", "pattern,score_type,points,comment", "Shopify, web , 5 ,a, b", "Gtag,Google Analytics", "x,y,z,w", "one")], "value string")
    assert [tuple(r) for r in readers.signatures(rows).collect()] == [("shopify", "web", 5, "a, b"), ("gtag", "match", 0, "Google Analytics")]
