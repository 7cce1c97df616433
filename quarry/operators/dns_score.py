"""Web, e-mail, budget and security scores of a domain's DNS records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import filled, values
from .detect import score

KINDS = ("web", "email", "budget", "security")

# Parts of a canonical name and the points they give.
CNAME_POINTS = [
    ("cloudflare", {"budget": 2, "web": 2, "security": 2}),
    ("cloudfront", {"budget": 3, "web": 3}),
    ("fastly", {"budget": 4, "web": 3}),
    ("akamai", {"budget": 5, "web": 4}),
    ("cdn77", {"budget": 2, "web": 2}),
    ("bunnycdn", {"budget": 2, "web": 2}),
    ("stackpath", {"budget": 3, "web": 2}),
    ("keycdn", {"budget": 2, "web": 2}),
    ("edgecast", {"budget": 3, "web": 3}),
    ("amazonaws.com", {"budget": 3, "web": 3}),
    ("awsglobalaccelerator", {"budget": 4, "web": 3}),
    ("azure", {"budget": 4, "web": 3}),
    ("googleusercontent", {"budget": 3, "web": 3}),
    ("googleapis", {"budget": 3, "web": 3}),
    ("digitalocean", {"budget": 2, "web": 2}),
    ("linode", {"budget": 2, "web": 2}),
    ("vultr", {"budget": 2, "web": 2}),
    ("shopify", {"budget": 2, "web": 2}),
    ("myshopify", {"budget": 2, "web": 2}),
    ("bigcommerce", {"budget": 3, "web": 2}),
    ("wix", {"budget": -1}),
    ("weebly", {"budget": -1}),
    ("squarespace", {"budget": 1, "web": 1}),
    ("webflow", {"budget": 2, "web": 2}),
    ("vercel", {"budget": 2, "web": 4}),
    ("netlify", {"budget": 2, "web": 3}),
    ("pages.dev", {"budget": 1, "web": 3}),
    ("workers.dev", {"budget": 2, "web": 4}),
    ("fly.dev", {"budget": 2, "web": 3}),
    ("railway", {"budget": 2, "web": 3}),
    ("render", {"budget": 2, "web": 3}),
    ("heroku", {"budget": 2, "web": 2}),
    ("incapsula", {"budget": 4, "security": 4}),
    ("imperva", {"budget": 4, "security": 4}),
    ("sucuri", {"budget": 3, "security": 3}),
    ("hubspot", {"budget": 3, "web": 2}),
    ("marketo", {"budget": 4, "web": 2}),
    ("pardot", {"budget": 4, "web": 2}),
    ("salesforce", {"budget": 5, "web": 3}),
    ("mailchimp", {"budget": 2, "web": 1}),
    ("auth0", {"budget": 3, "security": 3, "web": 2}),
    ("okta", {"budget": 4, "security": 4, "web": 2}),
    ("onelogin", {"budget": 3, "security": 3}),
    ("stripe", {"budget": 3, "web": 3, "security": 2}),
    ("paypal", {"budget": 2, "web": 1}),
    ("zendesk", {"budget": 3, "web": 2}),
    ("intercom", {"budget": 3, "web": 2}),
    ("freshdesk", {"budget": 2, "web": 1}),
    ("drift", {"budget": 3, "web": 2}),
    ("github", {"budget": 2, "web": 3}),
    ("gitlab", {"budget": 2, "web": 3}),
    ("bitbucket", {"budget": 2, "web": 2}),
    ("wistia", {"budget": 3, "web": 2}),
    ("vimeo", {"budget": 2, "web": 2}),
    ("youtube", {"web": 1}),
    ("dreamhost", {"web": 1}),
    ("siteground", {"budget": 1, "web": 1}),
    ("000webhost", {"budget": -2, "web": -1}),
    ("freenom", {"budget": -2, "web": -1}),
]


def dns_scores(mx_rules: list[tuple[str, str, int]] = (), txt_rules: list[tuple[str, str, int]] = ()) -> Column:
    """``struct(web, email, budget, security)`` over ``dns_mx, dns_txt, dns_aaaa, dns_cname``, each between 0 and 10.

    Rules (pattern, kind of score, points) for mail hosts and text records are the caller's.
    """
    cname = F.lower(filled("dns_cname"))
    servers = F.size(values("dns_mx"))
    newer = F.size(values("dns_aaaa")) > 0
    gains: dict[str, list[Column]] = {kind: [] for kind in KINDS}
    rules = F.array(*[F.struct(F.lit(part).alias("part"), *[F.lit(points.get(k, 0)).alias(k) for k in KINDS]) for part, points in CNAME_POINTS])
    hit = F.filter(rules, lambda r: F.contains(cname, r["part"]))
    total = lambda kind: F.aggregate(hit, F.lit(0), lambda a, r: a + r[kind])
    for kind in KINDS:
        gains[kind].append(total(kind))
    for name, listed in (("dns_mx", mx_rules), ("dns_txt", txt_rules)):
        if listed:
            found = score(F.lower(filled(name)), list(listed))
            for kind in {k for _, k, _ in listed} & set(KINDS):
                gains[kind].append(found[kind])
    gains["web"].append(F.when(newer, 1).otherwise(0))
    gains["security"].append(F.when(newer, 1).otherwise(0))
    gains["email"].append(F.when(servers >= 3, 2).when(servers == 2, 1).otherwise(0))
    gains["budget"].append(F.when(servers >= 3, 1).otherwise(0))
    return F.struct(*[F.greatest(F.lit(0), F.least(F.lit(10), reduce(lambda a, b: a + b, gains[kind]))).alias(kind) for kind in KINDS])
