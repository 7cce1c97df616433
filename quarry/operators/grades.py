"""Labels and grades that pages show: providers, mail security, badges, ages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, filled, has_value, humanize, values


def _table(text: str) -> list[tuple[list[str], str]]:
    return [([p.strip() for p in k.split(",")], name.strip()) for k, name in (line.split("=") for line in text.strip().splitlines())]


# Parts of a mail host and the provider; on a store's page, a technology's page, in the explorer.
STORE_MAIL = _table("""
google, googlemail = Google Workspace
outlook, microsoft = Microsoft 365
zoho = Zoho Mail
protonmail, proton = ProtonMail
icloud, apple = Apple iCloud
yandex = Yandex Mail
mail.ru = Mail.ru
fastmail = Fastmail
migadu = Migadu
forwardemail = Forward Email
improvmx = ImprovMX
mimecast = Mimecast
barracuda = Barracuda
messagelabs = Broadcom/Symantec
pphosted = Proofpoint
emailsrvr = Rackspace
secureserver = GoDaddy
registrar-servers = Namecheap
titan = Titan Email
hey = HEY (Basecamp)
mailgun = Mailgun
sendgrid = SendGrid
shopify = Shopify Mail
""")
TECH_MAIL = _table("""
google = Google Workspace
outlook = Microsoft 365
zoho = Zoho Mail
protonmail = ProtonMail
icloud = Apple iCloud
yandex = Yandex Mail
fastmail = Fastmail
shopify = Shopify Mail
secureserver = GoDaddy
titan = Titan Email
mailgun = Mailgun
sendgrid = SendGrid
mimecast = Mimecast
pphosted = Proofpoint
""")
EXPLORER_MAIL = _table("""
google, aspmx = Google Workspace
outlook, microsoft = Microsoft 365
protonmail, proton = Proton Mail
zoho = Zoho Mail
mimecast = Mimecast
barracuda = Barracuda
pphosted, proofpoint = Proofpoint
yahoodns, yahoo = Yahoo Mail
secureserver, godaddy = GoDaddy Email
ovh = OVH Mail
""")
# Parts of a name server and the provider.
NAME_SERVERS = _table("""
cloudflare = Cloudflare
awsdns = Amazon Route 53
google = Google Cloud DNS
dynect = Oracle Dyn
domaincontrol = GoDaddy
registrar-servers = Namecheap
nsone = NS1
ultradns = UltraDNS
digitalocean = DigitalOcean
vultr = Vultr
""")


def _has(text: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def _first(steps: list[tuple[Column, str]]) -> Column:
    found = F.when(*steps[0])
    for step in steps[1:]:
        found = found.when(*step)
    return found


def _provider(text: Column, table: list[tuple[list[str], str]], alphabetical: bool = True) -> Column:
    """The first part that occurs: in the order of the parts, or as listed."""
    if alphabetical:
        table = [([p], name) for p, name in sorted((p, name) for parts, name in table for p in parts)]
    return _first([(_has(text, *parts), name) for parts, name in table])


def mail_provider(mx: str | Column, table=STORE_MAIL) -> Column:
    """The provider of the first mail host; null if none is known."""
    return _provider(F.lower(F.split(filled(col(mx)), "\\|")[0]), table)


def explorer_mail_provider(mx: str | Column) -> Column:
    return _provider(F.lower(filled(col(mx))), EXPLORER_MAIL, False)


def dns_provider(nameservers: str | Column) -> Column:
    """The provider of the first name server, else the server's last two labels."""
    first = F.lower(F.split(filled(col(nameservers)), "\\|")[0])
    return F.when(first != "", F.coalesce(_provider(first, NAME_SERVERS), F.substring_index(first, ".", -2)))


def spf_grade(txt: str | Column) -> Column:
    """gold, silver or bronze of the first SPF record; null without one."""
    record = F.get(F.filter(F.split(filled(col(txt)), "\\|"), lambda r: F.trim(r).startswith("v=spf1")), F.lit(0))
    includes, strict = F.regexp_count(record, F.lit("include:\\S+")), _has(record, "-all")
    closed = strict | _has(record, "~all")
    return F.when(record.isNotNull(), F.when((includes >= 3) & strict, "gold").when((includes >= 2) & closed, "gold").when(closed, "silver").otherwise("bronze"))


def dmarc_grade(txt: str | Column) -> Column:
    """gold or silver of the DMARC policy, silver of a DKIM key alone; else null."""
    records = F.split(filled(col(txt)), "\\|")
    policy = F.get(F.filter(records, lambda r: F.contains(r, F.lit("v=DMARC1"))), F.lit(0))
    dkim = F.exists(records, lambda r: F.contains(r, F.lit("v=DKIM1")) | F.contains(r, F.lit("k=rsa")))
    return F.when(_has(policy, "p=reject", "p=quarantine"), "gold").when(_has(policy, "p=none") | dkim, "silver")


def _by_count(n: Column, gold: int, silver: int, bronze: int = 1) -> Column:
    return F.when(n >= gold, "gold").when(n >= silver, "silver").when(n >= bronze, "bronze")


def badges() -> Column:
    """``struct`` of the seven sections' badges over the row's columns; null: no badge."""
    low = lambda name: F.lower(filled(F.col(name)))
    mail, org, registrar, issuer = explorer_mail_provider("dns_mx"), low("bgp_asn_org"), low("rdap_registrar"), low("ctl_issuer")
    dated, names = has_value("rdap_domain_created_at"), F.coalesce(F.col("ctl_subdomain_count"), F.lit(0))
    best = F.least(F.coalesce("tranco_rank", F.lit(999_999_999)), F.coalesce("majestic_rank", F.lit(999_999_999)))
    return F.struct(
        _by_count(F.size(values("http_tech")), 8, 4).alias("tech"),
        _by_count(F.size(values("http_apps")), 5, 2).alias("app"),
        F.when(mail.isin("Google Workspace", "Microsoft 365", "Proofpoint", "Mimecast"), "gold").when(mail.isNotNull(), "silver").when(has_value("dns_mx"), "bronze").alias("dns"),
        F.when(_has(org, "amazon", "aws", "google", "gcp", "cloudflare", "microsoft", "azure"), "gold").when(_has(org, "fastly", "akamai", "digitalocean", "hetzner", "ovh", "linode"), "silver").when(has_value("bgp_asn_org"), "bronze").alias("network"),
        F.when(_has(registrar, "markmonitor", "csc", "networksolutions", "safenames"), "gold").when(dated & has_value("rdap_registrar"), "silver").when(dated, "bronze").alias("domain"),
        F.when((names >= 20) | _has(issuer, "digicert", "globalsign"), "gold").when((names >= 5) | _has(issuer, "amazon", "sectigo"), "silver").when(has_value("ctl_issuer"), "bronze").alias("ssl"),
        F.when(best <= 100_000, "gold").when(best <= 500_000, "silver").when(best <= 2_000_000, "bronze").alias("rankings"),
    )


def age_short(created: str | Column, as_of: Column) -> Column:
    """Days, months of 30 days or years of 365 days, as ``12d``, ``3m``, ``7y``."""
    days = F.datediff(as_of, col(created))
    part = lambda n: F.floor(days / n).cast("string")
    return F.when(days < 30, F.concat(days.cast("string"), F.lit("d"))).when(days < 365, F.concat(part(30), F.lit("m"))).otherwise(F.concat(part(365), F.lit("y")))


def age_long(created: str | Column, as_of: Column) -> Column:
    """The same as ``12 days``, ``3 months``, ``7 years`` or ``7y 2m``."""
    days = F.datediff(as_of, col(created))
    years, months = F.floor(days / 365), F.floor((days % 365) / 30)
    return F.when(days < 30, F.format_string("%d days", days)).when(days < 365, F.format_string("%d months", F.floor(days / 30))).when(months > 0, F.format_string("%dy %dm", years, months)).otherwise(F.format_string("%d years", years))


def freshness(at: str | Column, as_of: Column) -> Column:
    """``24h``, ``7d`` or ``30d``; null beyond."""
    hours = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(col(at).cast("timestamp"))) / 3600
    return F.when(hours <= 24, "24h").when(hours <= 24 * 7, "7d").when(hours <= 24 * 30, "30d")


def required_workers(inflow: Column, per_worker: Column) -> Column:
    return F.when(per_worker > 0, F.ceil(inflow / per_worker).cast("int"))


def health(ratio: Column) -> Column:
    """Drain over inflow: keeping up, lagging or behind."""
    return F.when(ratio >= 0.9, "ok").when(ratio >= 0.5, "warning").otherwise("critical")


def route(slug: str | Column) -> Column:
    """``struct(kind, tech, country)`` of a slug of the top lists or of a comparison ``a-vs-b``; null for any other."""
    text = col(slug)
    using_in, using_, place, versus = "^shopify-stores-using-(.+)-in-([a-z]{2})$", "^shopify-stores-using-(.+)$", "^shopify-stores-([a-z]{2})$", "^(.+)-vs-(.+)$"
    part = lambda pattern, group=1: F.regexp_extract(text, pattern, group)
    make = lambda kind, tech, country: F.struct(F.lit(kind).alias("kind"), tech.alias("tech"), country.alias("country"))
    none = F.lit("")
    return (
        F.when(text.rlike(using_in), make("tech_in_country", humanize(part(using_in)), F.upper(part(using_in, 2))))
        .when(text.rlike(using_), make("tech", humanize(part(using_)), none))
        .when(text.rlike(place), make("country", none, F.upper(part(place))))
        .when(text.rlike(versus), make("compare", F.concat_ws("|", part(versus), part(versus, 2)), none))
    )


# countries' names in addresses of pages and their codes.
COUNTRY_SLUGS = dict(
    x.split(":")
    for x in (
        "united-states:us united-kingdom:gb canada:ca australia:au germany:de france:fr netherlands:nl sweden:se japan:jp south-korea:kr india:in brazil:br new-zealand:nz ireland:ie singapore:sg "
        "italy:it spain:es denmark:dk norway:no finland:fi belgium:be switzerland:ch austria:at poland:pl portugal:pt mexico:mx israel:il hong-kong:hk taiwan:tw uae:ae south-africa:za china:cn russia:ru "
        "turkey:tr czech-republic:cz hungary:hu romania:ro greece:gr ukraine:ua thailand:th vietnam:vn indonesia:id malaysia:my argentina:ar colombia:co chile:cl peru:pe philippines:ph nigeria:ng egypt:eg "
        "kenya:ke saudi-arabia:sa pakistan:pk bangladesh:bd"
    ).split()
)
# Suffixes of two labels that a slug may end in.
SLUG_SUFFIXES = "com.sg co.uk com.au co.nz com.br com.hk co.jp co.kr com.my com.ph co.th co.za com.tw com.mx co.in co.il com.sa com.ar com.co com.ng com.pk co.ke com.ua".split()


def slug_domain(slug: str | Column) -> Column:
    """A slug as the domain it stands for: its last word, or a known pair, is the suffix."""
    words = F.split(col(slug), "-")
    n = F.size(words)
    head = lambda less: F.array_join(F.slice(words, F.lit(1), n - less), "-")
    pair = F.array_join(F.slice(words, -2, 2), ".")
    return F.when(n < 3, F.array_join(words, ".")).when(pair.isin(SLUG_SUFFIXES), F.concat_ws(".", head(2), pair)).otherwise(F.concat_ws(".", head(1), F.element_at(words, -1)))


def store_route(slug: str | Column) -> Column:
    """Where a store's address leads: a country's list, else null: the page of :func:`slug_domain`."""
    pairs = [F.lit(x) for kv in COUNTRY_SLUGS.items() for x in kv]
    return F.concat(F.lit("/top/shopify-stores-"), F.try_element_at(F.create_map(*pairs), col(slug)))
