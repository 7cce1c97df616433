"""Detectors: rule tables matched against a response, as array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, filled
from ..rules import Rules, tech


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table(rules: Rules) -> Column:
    """Rules as one array literal; a lambda over it keeps the plan small however many there are."""
    group = lambda parts: f"array({', '.join(map(_quoted, parts))})"
    return F.expr("array(" + ", ".join(f"named_struct('name', {_quoted(name)}, 'any', array({', '.join(map(group, alternatives))}))" for name, alternatives in rules) + ")")


def matches(text: str | Column, rules: Rules) -> Column:
    """Names of the rules that hold in a lower-case text, in rule order."""
    if not rules:
        return F.expr("cast(array() as array<string>)")
    text = filled(col(text))
    holds = lambda r: F.exists(r["any"], lambda parts: F.forall(parts, lambda p: F.contains(text, p)))
    return F.transform(F.filter(table(rules), holds), lambda r: r["name"])


def score(text: str | Column, rules: list[tuple[str, str, int]]) -> Column:
    """``map`` of score type to points: rules (pattern, type, points) whose pattern occurs in a lower-case text."""
    text = filled(col(text))
    kinds = sorted({k for _, k, _ in rules})
    total = lambda kind: reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(p.lower())), n).otherwise(0) for p, k, n in rules if k == kind])
    return F.create_map(*[x for k in kinds for x in (F.lit(k), total(k))])


def first_match(steps: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds, else empty."""
    found = F.when(*steps[0])
    for step in steps[1:]:
        found = found.when(*step)
    return found.otherwise("")


def parts(body: str | Column) -> dict[str, Column]:
    """What rules look at, in lower case: script and link addresses, meta tags, inline scripts, all addresses, the page."""
    page = F.lower(filled(col(body)))
    every = lambda pattern, group=1: F.array_join(F.regexp_extract_all(page, F.lit(pattern), group), "\n")
    return {
        "scripts": every("(?s)<script[^>]+src=[\"']([^\"']+)[\"']"),
        "links": every("(?s)<link[^>]+href=[\"']([^\"']+)[\"']"),
        "meta": every("(?s)<meta[^>]*>", 0),
        "inline": every("(?s)<script[^>]*>(.*?)</script>"),
        "addresses": every("(?s)(?:src|href)=[\"']([^\"']+)[\"']"),
        "page": page,
    }


def detect_tech(responses: DataFrame, body: str = "body", headers: str | None = "headers", out: str = "tech") -> DataFrame:
    """Add the technologies of a response, sorted and distinct.  ``headers`` is a map with lower-case keys."""
    pieces = responses.withColumns({f"_p_{k}": v for k, v in parts(body).items()})
    p = lambda name: F.col(f"_p_{name}")
    lists = [
        matches(p("scripts"), tech.SCRIPTS),
        matches(p("links"), tech.LINKS),
        F.when(F.contains(p("meta"), F.lit("generator")), matches(p("meta"), tech.GENERATORS)),
        matches(p("inline"), tech.INLINE),
        matches(p("page"), tech.MARKUP),
        matches(p("addresses"), tech.ADDRESSES),
        F.array_compact(F.array(*[F.when(p("page").rlike(pattern), name) for pattern, name in tech.MARKUP_PATTERNS])),
    ]
    if headers is not None:
        value = lambda name: filled(F.try_element_at(F.col(headers), F.lit(name)))
        have = lambda name: F.coalesce(F.map_contains_key(headers, name), F.lit(False))
        lists.append(F.array_compact(F.array(*[F.when(F.lower(value(h)).rlike(pattern), name) for h, pattern, name in tech.HEADER_PATTERNS])))
        lists.append(F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [have(x[0]) for x in any_]), F.lit(name)) for name, any_ in tech.HEADER_NAMES])))
    empty = F.expr("cast(array() as array<string>)")
    found = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in lists])))
    return pieces.withColumn(out, found).drop(*[f"_p_{k}" for k in parts(body)])


def cdn(headers: str) -> Column:
    have = lambda name: F.coalesce(F.map_contains_key(headers, name), F.lit(False))
    server = F.lower(filled(F.try_element_at(F.col(headers), F.lit("server"))))
    steps = []
    for name, keys, word in tech.CDN:
        holds = reduce(lambda a, b: a | b, map(have, keys))
        steps.append((holds | server.rlike(rf"\b{word}\b") if word else holds, name))
    return first_match(steps)


def blocked(body: str, headers: str) -> Column:
    """The firewall that blocked a response, else empty."""
    page = F.lower(filled(body))
    test = lambda p: F.coalesce(F.map_contains_key(headers, p[1:]), F.lit(False)) if p.startswith("@") else F.contains(page, F.lit(p))
    return first_match([(reduce(lambda a, b: a | b, [reduce(lambda c, d: c & d, map(test, parts_)) for parts_ in any_]), name) for name, any_ in tech.BLOCKED])


def script_site(body: str) -> Column:
    """Does the page seem to be drawn by scripts?"""
    page = filled(body)
    has = lambda *needles: reduce(lambda a, b: a | b, [F.contains(page, F.lit(n)) for n in needles])
    pieces = F.size(F.split(page, "<script"))
    rest = F.octet_length(F.regexp_replace(page, "(?s)<script.*?</script>", ""))
    return has("data-reactroot", "data-v-", "ng-version", "__next", "__nuxt") | ((pieces >= 3) & has('id="root"', 'id="app"', 'id="__next"')) | ((pieces >= 5) & (rest < 200))


#: Technologies that DNS and hosting records show (field: part, name).
DNS_TECH = [
    ("dns_cname", "myshopify.com", "Shopify"), ("bgp_asn_org", "cloudflare", "Cloudflare"), ("dns_mx", "google", "Google Workspace"), ("dns_mx", "outlook", "Microsoft 365"), ("dns_mx", "microsoft", "Microsoft 365"),
    ("dns_txt", "spf.protection.outlook", "Microsoft 365"), ("dns_txt", "google-site-verification", "Google Search Console"), ("dns_txt", "facebook-domain-verification", "Meta Pixel"),
]
SHOP_ADDRESSES = ["23.227.36.", "23.227.37.", "23.227.38.", "23.227.39."]


def dns_tech(a: str = "dns_a") -> Column:
    by_ip = F.exists(F.split(filled(a), "\\|"), lambda ip: reduce(lambda x, y: x | y, [ip.startswith(p) for p in SHOP_ADDRESSES]))
    return F.array_distinct(F.array_compact(F.array(F.when(by_ip, "Shopify"), *[F.when(F.contains(F.lower(filled(f)), F.lit(part)), name) for f, part, name in DNS_TECH])))


def detect_apps(body: str | Column) -> Column:
    """Shop apps and plugins of a page, sorted and distinct."""
    from ..rules import apps

    page = F.lower(filled(col(body)))
    return F.array_sort(F.array_distinct(F.concat(*[matches(page, r) for r in (apps.SHOP_HOSTS, apps.SHOP_MARKERS, apps.PLUGINS, apps.PLUGIN_MARKERS)])))


def has_spf(txt: str | Column) -> Column:
    return F.contains(F.lower(filled(col(txt))), F.lit("v=spf1"))


def has_dmarc(txt: str | Column) -> Column:
    return F.contains(F.lower(filled(col(txt))), F.lit("v=dmarc1"))


def threat(*flags: str) -> Column:
    """Any flag set?"""
    from ..functions.text import flag

    return reduce(lambda a, b: a | b, map(flag, flags))


def evidence_items(evidence: str | Column) -> Column:
    """Array of (signal, value, bracket) of an evidence string."""
    parsed = F.transform(F.array_remove(F.split(filled(col(evidence)), "\\|"), ""), lambda x: F.struct(F.substring_index(x, ":", 1).alias("signal"), F.regexp_extract(x, "^[^:]*:(.*)→[^→]*$", 1).alias("value"), F.substring_index(x, "→", -1).alias("bracket")))
    return parsed
