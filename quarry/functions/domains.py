"""Column functions over domain names and countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, filled

#: Second-level suffixes that stand for a country.
TWO_PART = (
    "co.uk org.uk ac.uk gov.uk net.uk com.au co.au net.au org.au edu.au gov.au co.nz ac.nz net.nz org.nz co.za net.za org.za gov.za ac.za co.jp co.kr co.in co.il co.id co.th co.ke co.tz co.zw "
    "com.br net.br com.cn net.cn org.cn edu.cn com.mx com.ar com.sg com.my com.ph com.tw com.ua com.tr com.pk com.sa com.eg com.ng com.gh com.co com.pe com.ve com.hk"
).split()
#: Country-code suffixes that stand for a country (vanity ones are left out).
ONE_PART = (
    "fr de jp ca uk it es nl se no dk fi be ch at pl pt br mx il in sg ae za nz au ie kr tw hk ru tr cz hu ro bg gr ua th vn id my ar pe ve eg ng gh sa pk ke tz zw ph cl uy ec cr pa gt hn py bo "
    "cn hr si sk rs ba lt lv ee lu mt cy is us eu bd np lk kh mm mn"
).split()
#: Languages and the country each most likely means.
LANGUAGES = dict(
    x.split(":")
    for x in (
        "fr:FR de:DE ja:JP ko:KR zh:CN ru:RU pt:BR it:IT nl:NL sv:SE da:DK no:NO fi:FI pl:PL cs:CZ hu:HU ro:RO bg:BG el:GR tr:TR th:TH vi:VN id:ID ms:MY uk:UA he:IL ar:SA hi:IN bn:BD ta:IN te:IN es:ES sco:GB"
    ).split()
)
#: What the query-time expression leaves out of the tables above.
NOT_AT_QUERY = {"suffixes": "co.zw ba bo cr cy ec gt hn kh mm mn mt np pa py tz uy ve zw".split(), "languages": ["bn", "ta", "te"]}


def _country_of_suffix(suffix: Column, known: list[str]) -> Column:
    """A known suffix's country: its last label in capitals, but GB for uk."""
    last = F.substring_index(suffix, ".", -1)
    return F.when(suffix.isin(known), F.when(last == "uk", F.lit("GB")).otherwise(F.upper(last)))


def _country_of_language(language: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), language)


def infer_country(tld: str | Column, language: str | Column, rdap: str | Column, bgp: str | Column) -> Column:
    """The country at write time: suffix, language, registrant, English, hosting country, else US."""
    suffix, lang = F.trim(F.lower(filled(tld))), F.substring_index(F.trim(F.lower(filled(language))), "-", 1)
    two_letters = lambda c: F.when(F.length(F.trim(filled(c))) == 2, F.trim(F.upper(filled(c))))
    return F.coalesce(
        _country_of_suffix(suffix, TWO_PART + ONE_PART), _country_of_language(lang, LANGUAGES), two_letters(rdap), F.when(lang == "en", F.lit("US")), two_letters(bgp), F.lit("US")
    )


def country(stored: str | Column = "inferred_country", tld: str | Column = "ctl_tld", language: str | Column = "http_language", bgp: str | Column = "bgp_asn_country", ip: str | Column = "bgp_ip") -> Column:
    """The country at query time; never empty.  The stored one wins."""
    suffixes = [x for x in TWO_PART + ONE_PART if x not in NOT_AT_QUERY["suffixes"]]
    languages = {k: v for k, v in LANGUAGES.items() if k not in NOT_AT_QUERY["languages"]} | {"en": "US"}
    hosted = filled(bgp)
    return F.coalesce(
        F.nullif(col(stored), F.lit("")),
        _country_of_suffix(filled(tld), suffixes),
        _country_of_language(filled(language), languages),
        F.when((F.length(hosted) == 2) & ~((hosted == "CA") & F.startswith(filled(ip), F.lit("23.227.3"))), hosted),
        F.lit("US"),
    )


#: Suffixes of two labels below which a registrable name takes three.
BASE_SUFFIXES = (
    "co.uk org.uk me.uk ltd.uk plc.uk net.uk sch.uk ac.uk gov.uk nhs.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz govt.nz co.za org.za com.br net.br org.br gov.br co.jp ne.jp or.jp ac.jp go.jp "
    "com.cn net.cn org.cn gov.cn co.in net.in org.in co.kr or.kr com.mx com.ar com.tr com.sg com.my com.hk com.tw co.il co.id co.th"
).split()


def strip_www(c: str | Column) -> Column:
    """Lower case, without any leading ``www.``, however often it is repeated."""
    return F.regexp_replace(F.lower(F.trim(col(c))), "^(www\\.)+", "")


def last_label(c: str | Column) -> Column:
    return F.substring_index(col(c), ".", -1)


def parse_domain(c: str | Column, suffixes: list[str] = BASE_SUFFIXES) -> Column:
    """``struct(base, tld, subdomain, depth)`` of a host name, or null for a name of fewer than two labels."""
    name = F.trim(F.regexp_replace(F.lower(col(c)), "^\\*\\.", ""))
    labels = F.split(name, "\\.")
    n = F.size(labels)
    pair = F.array_join(F.slice(labels, -2, 2), ".")
    taken = F.when((n >= 3) & pair.isin(suffixes), 3).otherwise(2)
    parsed = F.struct(
        F.array_join(F.slice(labels, -taken, taken), ".").alias("base"),
        F.when(taken == 3, pair).otherwise(F.element_at(labels, -1)).alias("tld"),
        F.array_join(F.slice(labels, F.lit(1), F.least(F.greatest(n - taken, F.lit(0)), F.lit(50))), "|").alias("subdomain"),
        F.greatest(n - taken, F.lit(0)).alias("depth"),
    )
    return F.when(n >= 2, parsed)


def lookup_name(c: str | Column) -> Column:
    """What a user types, as a domain: lower case, no scheme, no path."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(col(c))), "^https?://", ""), "/.*$", "")


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def suffix_match(c: str | Column, suffixes: list[str], strict: bool = False) -> Column:
    """Does the name end in one of the suffixes?  ``strict`` asks for a label's boundary."""
    name = col(c)
    found = F.lit(False)
    for s in suffixes:
        found = found | (((name == s) | F.endswith(name, F.lit("." + s))) if strict else F.endswith(name, F.lit(s)))
    return found


def crawl_gate(domain: str | Column, mx: str | Column, txt: str | Column, suffixes: list[str]) -> Column:
    """Worth a crawl: a listed suffix, a name of four characters or more without two digits in a row, fewer than two hyphens, mail and SPF."""
    domain = col(domain)
    name = F.element_at(F.split(domain, "\\."), 1)
    return (
        suffix_match(domain, suffixes, True)
        & (F.length(name) >= 4)
        & ~name.rlike("[0-9][0-9]")
        & (F.length(domain) - F.length(F.replace(domain, F.lit("-"), F.lit(""))) < 2)
        & (filled(mx) != "")
        & F.contains(filled(txt), F.lit("v=spf1"))
    )
