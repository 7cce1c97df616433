"""Language of a text by its function words, else by what the page declares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import html_language, visible_text
from .text import col, filled

#: Frequent short words of each language.
FUNCTION_WORDS = {
    "da": "og det er en til af på med ikke der som for".split(),
    "de": "der die und das ist nicht mit von ein zu den auf".split(),
    "en": "the of and to in is that for it with was on".split(),
    "es": "el la de que y en los se las por con una".split(),
    "fi": "ja on ei se että oli hän joka mutta niin kun myös".split(),
    "fr": "le la les des et est un une dans pour que qui".split(),
    "it": "il di che è la per un non sono con del della".split(),
    "nl": "de het een van en is dat niet op te zijn met".split(),
    "no": "og det er en til av på med ikke som for jeg".split(),
    "pl": "nie się na jest że do to jak co ale za od".split(),
    "pt": "o de que e do da em um para não com uma".split(),
    "sv": "och det är en som att på för med inte av till".split(),
    "tr": "bir ve bu için da de ne çok ama gibi daha olan".split(),
}
#: Codes of three letters and of two; other codes stay as they are.
TWO_LETTERS = dict(
    x.split(":")
    for x in (
        "eng:en fra:fr deu:de spa:es ita:it por:pt nld:nl rus:ru jpn:ja zho:zh kor:ko ara:ar arb:ar hin:hi tur:tr pol:pl ukr:uk vie:vi tha:th ces:cs ell:el hun:hu ron:ro bul:bg hrv:hr srp:sr slk:sk slv:sl dan:da fin:fi nor:no "
        "nob:nb nno:nn swe:sv cat:ca eus:eu glg:gl ind:id msa:ms tgl:tl heb:he fas:fa urd:ur ben:bn tam:ta tel:te mar:mr guj:gu kan:kn mal:ml pan:pa mya:my khm:km lao:lo kat:ka hye:hy lit:lt lav:lv est:et sqi:sq mkd:mk bos:bs "
        "isl:is gle:ga cym:cy afr:af swa:sw amh:am nep:ne sin:si mon:mn kaz:kk uzb:uz aze:az bel:be tat:tt"
    ).split()
)
#: Texts shorter than this are not judged.
LEAST = 100


def by_words(text: str | Column, least_share: float = 0.08) -> Column:
    """The language whose function words make up most of a text's words; null below ``least_share`` or for a short text.

    Ties go to the language that is first in the alphabet.
    """
    lower = F.lower(filled(col(text)))
    words = F.filter(F.split(lower, "[^\\p{L}]+"), lambda w: w != "")
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    best = F.array_max(F.array(*[F.struct(count(listed).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, listed) in enumerate(sorted(FUNCTION_WORDS.items()))]))
    return F.when((F.length(lower) >= LEAST) & (best["n"] >= F.size(words) * least_share) & (best["n"] > 0), best["lang"])


def two_letters(code: str | Column) -> Column:
    """A language's code of three letters as one of two, where it has one."""
    pairs = [F.lit(x) for kv in TWO_LETTERS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(code)), col(code))


def judged_text(title: str | Column, description: str | Column, html: str | Column) -> Column:
    """What a page's language is judged by: title, description, and the first 500 visible characters."""
    return F.array_join(F.filter(F.array(filled(title), filled(description), visible_text(html)), lambda x: x != ""), " ")


def language(text: str | Column, html: str | Column, header: str | Column | None = None) -> Column:
    """By its words, else as declared by the page, else by the header; empty if unknown."""
    return F.coalesce(by_words(text), html_language(html, header))
