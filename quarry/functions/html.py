"""Column functions over raw HTML; regular expressions of the common Java and RE2 subset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.pages import KNOWN, ORDER
from .text import col, filled


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def title(html: str | Column) -> Column:
    return F.left(F.trim(F.regexp_extract(filled(html), "(?is)<title[^>]*>([^<]{1,500})</title>", 1)), F.lit(200))


def h1(html: str | Column) -> Column:
    """The first heading, inner tags as spaces."""
    return F.left(_spaces(F.regexp_replace(F.regexp_extract(filled(html), "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")), F.lit(200))


def meta_description(html: str | Column) -> Column:
    """Either order of the attributes."""
    first = F.regexp_extract(filled(html), "(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)
    second = F.regexp_extract(filled(html), "(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+name=[\"']description[\"']", 1)
    return F.left(F.trim(F.coalesce(F.nullif(first, F.lit("")), second)), F.lit(500))


def nav_text(html: str | Column) -> Column:
    """Texts of the links in the first ``nav`` (else ``header``), joined by spaces."""
    page = filled(html)
    block = F.coalesce(F.nullif(F.regexp_extract(page, "(?is)<nav[^>]*>(.*?)</nav>", 1), F.lit("")), F.regexp_extract(page, "(?is)<header[^>]*>(.*?)</header>", 1))
    return F.left(_spaces(F.array_join(F.regexp_extract_all(block, F.lit("(?is)<a[^>]*>([^<]{1,100})</a>"), 1), " ")), F.lit(300))


def visible_text(html: str | Column, most: int = 500) -> Column:
    text = filled(html)
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]+>", "&[a-zA-Z0-9#]+;"):
        text = F.regexp_replace(text, pattern, " ")
    return F.left(_spaces(text), F.lit(most))


def og_type(html: str | Column) -> Column:
    first = F.regexp_extract(filled(html), "(?is)<meta[^>]+property=[\"']og:type[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)
    second = F.regexp_extract(filled(html), "(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+property=[\"']og:type[\"']", 1)
    return F.lower(F.trim(F.coalesce(F.nullif(first, F.lit("")), second)))


def html_language(html: str | Column, header: str | Column | None = None) -> Column:
    """The page's declared language (else the header's): lower case, hyphens, the first of several; shorter than two letters is none."""
    first = lambda c: F.regexp_extract(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")), "^[^,;\\s]*", 0)
    told = lambda c: F.when(F.octet_length(first(c)) >= 2, first(c))
    page = told(F.regexp_extract(filled(html), "(?is)<html[^>]*\\blang\\s*=\\s*[\"']([^\"']+)[\"']", 1))
    return F.coalesce(page, *([told(filled(header))] if header is not None else []), F.lit(""))


def hrefs(html: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(filled(html)), F.lit("(?s)href=[\"']([^\"']+)[\"']"), 1)


def page_paths(html: str | Column, domain: str | Column, known: list[str] | None = KNOWN, order: list[list[str]] = ORDER, most: int = 10) -> Column:
    """Internal paths a page links to, those named ``known`` or below one (None: all), first kinds of ``order`` first.

    Absolute links count where they lead to the same domain.  Query, fragment
    and trailing slash go; copies go.
    """
    domain = col(domain)
    base = F.concat(F.lit("://"), domain)
    links = F.filter(hrefs(html), lambda h: ~h.rlike("^(#|mailto:|tel:|javascript:|data:|//)"))
    same = lambda h: F.regexp_replace(h, "^https?://(www\\.)?", "://").startswith(base)
    own = F.transform(links, lambda h: F.when(h.startswith("/"), h).when(h.rlike("^https?://"), F.when(same(h), F.regexp_extract(h, "^https?://[^/?#]*(.*)$", 1))).when(~F.contains(h, F.lit(":")), F.concat(F.lit("/"), h)))
    clean = F.transform(F.filter(own, lambda p: p.isNotNull()), lambda p: F.regexp_replace(F.regexp_replace(p, "[?#].*$", ""), "/+$", ""))
    clean = F.array_distinct(F.filter(clean, lambda p: p != ""))
    if known is not None:
        exact, below = F.array(*map(F.lit, known)), F.array(*[F.lit(k + "/") for k in known])
        clean = F.filter(clean, lambda p: F.array_contains(exact, p) | F.exists(below, lambda k: p.startswith(k)))
    rank = lambda p: F.coalesce(*[F.when(p.isin(names), F.lit(i)) for i, names in enumerate(order)], F.lit(len(order)))
    ranked = F.array_sort(F.transform(clean, lambda p, i: F.struct(rank(p).alias("r"), i.alias("i"), p.alias("p"))))
    return F.slice(F.transform(ranked, lambda x: x["p"]), 1, most)


def unhide_email(hexed: str | Column) -> Column:
    """An address hidden as hexadecimal bytes: the first byte is the key that the others are combined with."""
    raw = F.lower(col(hexed))
    byte = lambda at: F.conv(F.substring(raw, at, F.lit(2)), 16, 10).cast("int")
    letters = F.transform(F.sequence(F.lit(3), F.length(raw) - 1, F.lit(2)), lambda at: F.char(byte(at).bitwiseXOR(byte(F.lit(1)))))
    return F.when(raw.rlike("^([0-9a-f]{2}){2,}$"), F.array_join(letters, ""))


# How addresses are written in pages; groups are name, domain and, where it stands apart, last label.
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MAILTO = rf"(?i)mailto:({ADDRESS})"
MAILTO_ENCODED = r"(?i)mailto:([A-Za-z0-9._%+-]+)%40([A-Za-z0-9.-]+)\.([A-Za-z]{2,})"
DATA_ATTRIBUTE = rf"(?i)data-(?:email|mail|contact)=[\"']({ADDRESS})[\"']"
RAW_ADDRESS = rf"\b{ADDRESS}\b"
AT_DOT_BRACKETS = r"(?i)\b([A-Za-z0-9._%+-]+)\s*[\[\(]\s*@\s*[\]\)]\s*([A-Za-z0-9.-]+)\s*[\[\(]\s*\.\s*[\]\)]\s*([A-Za-z]{2,})\b"
AT_DOT_WORDS = r"\b([A-Za-z0-9._%+-]+)\s+(?:AT|at|At)\s+([A-Za-z0-9.-]+)\s+(?:DOT|dot|Dot)\s+([A-Za-z]{2,})\b"
AT_DOT_SPACED = r"\b([A-Za-z0-9._%+-]+)\s+@\s+([A-Za-z0-9.-]+)\s+\.\s+([A-Za-z]{2,})\b"
AT_DOT_BRACES = r"(?i)\b([A-Za-z0-9._%+-]+)\s*\{(?:at|@)\}\s*([A-Za-z0-9.-]+)\s*\{(?:dot|\.)\}\s*([A-Za-z]{2,})\b"
ENTITIES = r"(?i)\b([A-Za-z0-9._%+-]+)(?:&#64;|&#x40;|&commat;)([A-Za-z0-9.-]+)(?:&#46;|&#x2e;|&period;)([A-Za-z]{2,})\b"
SCRIPT_JOINED = r"[\"']([A-Za-z0-9._%+-]+)[\"']\s*\+\s*[\"']@[\"']\s*\+\s*[\"']([A-Za-z0-9.-]+\.[A-Za-z]{2,})[\"']"
REVERSED = r"\b([a-z]{2,})\.([A-Za-z0-9.-]+)@([A-Za-z0-9._%+-]+)\b"
HIDDEN = r"(?i)data-cfemail=\"([0-9a-f]+)\""
# Addresses that match one of these are no contact.
EMAIL_REJECT = [
    r"^(noreply|no-reply|donotreply|do-not-reply)@",
    r"^(admin|webmaster|postmaster|hostmaster|root)@",
    r"^(abuse|spam|mailer-daemon|daemon)@",
    r"@example\.(com|org|net)$",
    r"@(localhost|test|invalid)$",
    r"\.(png|jpg|jpeg|gif|svg|css|js|ico)$",
    r"@sentry\.io$",
    r"@.*\.(wixsite|squarespace|webflow)\.com$",
    r"^(test|testing|sample|demo|example|fake)@",
]
# Last labels that a contact's domain may have.
EMAIL_TLDS = "com org net edu gov io co ai app dev tech cloud biz info uk de fr es it nl be ch at au nz ca us br mx jp cn kr sg hk tw in ru pl se no dk fi ie pt".split()
#: Fixed value: bytes of a body that are searched for addresses.
BODY_BYTES = 100_000
#: Fixed value: characters of a cleaned page.
CLEAN_CHARS = 300_000


def limit_body(html: str | Column, most: int = BODY_BYTES) -> Column:
    """What follows the first ``body`` tag (else the page), cut at ``most`` bytes; a character cut in two goes."""
    page = filled(html)
    body = F.when(page.rlike("(?is)<body[^>]*>"), F.regexp_extract(page, "(?is)<body[^>]*>(.*)", 1)).otherwise(page)
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), 1, most).cast("string")), "�$", "")
    return F.when(F.octet_length(body) > most, cut).otherwise(body)


def clean(html: str | Column, most: int = CLEAN_CHARS) -> Column:
    """A page without styles and comments, cut at ``most`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(filled(html), "(?is)<style\\b[^>]*>.*?</style>", " "), "(?s)<!--.*?-->", " "), F.lit(most))


def emails(html: str | Column, most: int = 10, limit: int | None = BODY_BYTES) -> Column:
    """Addresses in a page, plain or hidden in twelve ways; lower case, first occurrences, at most ``most``.

    ``limit`` bounds the bytes of the body that are searched (None: all).  An
    expression runs only on pages that hold the text it cannot match without.
    """
    page = filled(html) if limit is None else limit_body(html, limit)
    none = F.expr("cast(array() as array<string>)")
    has = lambda *needles: reduce(lambda a, b: a | b, [F.contains(page, F.lit(n)) for n in needles])
    low = lambda *needles: reduce(lambda a, b: a | b, [F.contains(F.lower(page), F.lit(n)) for n in needles])
    every = lambda pattern, group=0: F.regexp_extract_all(page, F.lit(pattern), group)
    joined = lambda pattern, form="$1@$2.$3": F.transform(every(pattern), lambda x: F.regexp_replace(x, pattern, form))
    uncovered = F.filter(F.transform(every(HIDDEN, 1), unhide_email), lambda x: F.contains(x, F.lit("@")) & F.contains(x, F.lit(".")) & (F.octet_length(x) > 5) & (F.octet_length(x) < 100))
    found = [
        (has("data-cfemail") | has("DATA-CFEMAIL"), uncovered),
        (has("@") & F.contains(F.lower(page), F.lit("mailto:")), every(MAILTO, 1)),
        (has("%40"), joined(MAILTO_ENCODED)),
        (has("@") & F.contains(F.lower(page), F.lit("data-")), every(DATA_ATTRIBUTE, 1)),
        (has("@"), every(RAW_ADDRESS)),
        (has("@") & has("[", "("), joined(AT_DOT_BRACKETS)),
        (has("AT", "at", "At") & has("DOT", "dot", "Dot"), joined(AT_DOT_WORDS)),
        (has("@"), joined(AT_DOT_SPACED)),
        (has("{") & low("{at}", "{@}"), joined(AT_DOT_BRACES)),
        (has("&") & low("&#64;", "&#x40;", "&commat;"), joined(ENTITIES)),
        (has("@") & has("+"), joined(SCRIPT_JOINED, "$1@$2")),
        (has("direction:rtl", "data-reverse"), F.transform(every(REVERSED), lambda x: F.reverse(x))),
    ]
    all_ = F.array_distinct(F.transform(F.concat(*[F.when(gate, x).otherwise(none) for gate, x in found]), lambda x: F.trim(F.lower(x))))
    domain = lambda x: F.get(F.split(x, "@"), F.lit(1))
    good = F.filter(all_, lambda x: ~x.rlike("|".join(EMAIL_REJECT)) & (F.size(F.split(x, "@")) == 2) & (F.substring_index(x, "@", 1) != "") & (F.octet_length(domain(x)) > 2) & F.substring_index(domain(x), ".", -1).isin(EMAIL_TLDS))
    return F.slice(good, 1, most)


# Named character references and what they stand for, in the order they are replaced.
NAMED = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&trade;", "™"), ("&reg;", "®"), ("&copy;", "©")]


def code_point(number: Column) -> Column:
    """The character of a code point; empty for numbers that have none."""
    n = number.cast("long")
    low = lambda shift: F.shiftright(n, shift).bitwiseAND(63) + 128
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    digits = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.shiftright(n, 6) + 0xC0), byte(low(0))))
        .when(n < 0x10000, F.concat(byte(F.shiftright(n, 12) + 0xE0), byte(low(6)), byte(low(0))))
        .otherwise(F.concat(byte(F.shiftright(n, 18) + 0xF0), byte(low(12)), byte(low(6)), byte(low(0))))
    )
    valid = (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(digits), "UTF-8")).otherwise("")


def unescape(c: str | Column) -> Column:
    """Character references decoded: twelve by name, the others by decimal number; null stays null."""
    text = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), NAMED, col(c))
    pieces = F.split(text, "&#\\d+;", -1)
    numbers = F.regexp_extract_all(text, F.lit("&#(\\d+);"), 1)
    decoded = F.transform(numbers, lambda n: F.coalesce(code_point(F.when(F.length(n) < 10, n.cast("long"))), F.lit("")))
    return F.array_join(F.flatten(F.zip_with(pieces, decoded, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
