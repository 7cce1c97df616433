"""Column functions that put values into the form that pages show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import code_point
from .text import col, filled


def number(c: str | Column) -> Column:
    """An integer with commas between thousands."""
    return F.format_number(col(c).cast("long"), 0)


def rank(c: str | Column) -> Column:
    """``#12,345``; null for none and for zero."""
    value = col(c).cast("long")
    return F.when(value != 0, F.concat(F.lit("#"), number(value)))


def date(c: str | Column) -> Column:
    """``Jan 05, 2024`` of an ISO date or time; other text as it is, empty as null."""
    text = F.nullif(col(c).cast("string"), F.lit(""))
    return F.coalesce(F.date_format(F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"), "MMM dd, yyyy"), text)


def moment(c: str | Column) -> Column:
    """``Jan 05, 2024 13:45 UTC`` of an ISO time; a dash for none."""
    text = F.nullif(col(c).cast("string"), F.lit(""))
    clean = F.replace(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    return F.coalesce(F.concat(F.date_format(F.try_to_timestamp(clean), "MMM dd, yyyy HH:mm"), F.lit(" UTC")), text, F.lit("\u2014"))


def percent(c: str | Column) -> Column:
    """A share as whole percent."""
    return F.concat(F.floor(col(c).cast("double") * 100 + 0.5).cast("string"), F.lit("%"))


# Parts of a content type and its short name, first match.
CONTENT_TYPES = [
    ("text/html", "HTML"), ("application/xhtml", "XHTML"), ("application/json", "JSON"), ("application/xml", "XML"), ("text/xml", "XML"), ("application/pdf", "PDF"), ("text/plain", "Text"),
    ("text/css", "CSS"), ("javascript", "JavaScript"), ("image/", "Image"), ("video/", "Video"), ("audio/", "Audio"),
]


def content_type(c: str | Column) -> Column:
    """The short name of a content type, else what stands before its parameters; empty as null."""
    text = F.nullif(col(c), F.lit(""))
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(part)), F.lit(name)) for part, name in CONTENT_TYPES], F.trim(F.substring_index(text, ";", 1)))


def flag(code: str | Column) -> Column:
    """A country code of two letters as its flag: two regional indicators; else empty."""
    upper = F.upper(filled(code))
    letter = lambda i: code_point(F.ascii(F.substring(upper, i, 1)) + F.lit(0x1F1A5))
    return F.when(F.octet_length(upper) == 2, F.concat(letter(1), letter(2))).otherwise("")


# Languages and the country whose flag stands for each.
LANGUAGE_FLAGS = dict(
    x.split(":")
    for x in "en:GB fr:FR de:DE es:ES pt:PT it:IT nl:NL ja:JP ko:KR zh:CN ru:RU ar:SA hi:IN tr:TR pl:PL sv:SE da:DK no:NO fi:FI cs:CZ th:TH vi:VN id:ID ms:MY uk:UA ro:RO el:GR he:IL hu:HU bg:BG".split()
)


def language_flag(language: str | Column) -> Column:
    """The flag of a language's first two letters; empty if it has none."""
    pairs = [F.lit(x) for kv in LANGUAGE_FLAGS.items() for x in kv]
    return F.coalesce(flag(F.try_element_at(F.create_map(*pairs), F.left(F.lower(filled(language)), F.lit(2)))), F.lit(""))


# Parts of an evidence item's tier and the badge they earn, first match; signals that earn silver by themselves.
EVIDENCE_BADGES = [(["enterprise", "top_10k", "top_50k", "mid_market", "top_100k", "top_500k"], "gold"), (["small", "top_1m"], "silver"), (["micro", "basic"], "bronze")]
SILVER_SIGNALS = ["tranco", "majestic", "ref_subnets"]


def evidence_badge(signal: Column, tier: Column) -> Column:
    low = F.lower(tier)
    found = [F.when(low.rlike("|".join(parts)), F.lit(badge)) for parts, badge in EVIDENCE_BADGES]
    return F.coalesce(*found, F.when(F.lower(signal).isin(SILVER_SIGNALS), F.lit("silver")), F.lit("bronze"))
