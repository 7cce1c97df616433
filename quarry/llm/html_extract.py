"""HTML extraction by the maximum-scoring subsequence.

A page becomes a sequence of words and tags, and each gets a score.  A tag's is
negative: the log odds that this tag stands in main text, moved below zero.  A
word's is positive, unless what encloses it tells otherwise: the elements
around it have features (their class, id and role words, and names such as
``nav``), and a feature that hardly ever holds main text makes its words score
below zero, as does standing outside the article of a page that names one.  All weights are counted on labelled pages, with a few counts in advance
for names and words that are known to mark page furniture.

One linear scan finds the contiguous run of the greatest score, the content
region; a second takes the runs of negative words out of it (adverts, forms,
reader comments and the like nested in the article).  What is left is joined
block by block.

Labelled pages are those whose markup names its article; their words are main
text if they lie in it outside known furniture.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Elements that break a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never page text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object", "title", "select")
#: Elements that hold page furniture wherever they stand.
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset head".split())
#: Words in class, id or role that mark page furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|sidebar|side|aside|widget|nav\w*|menu|breadcrumbs?|footer|foot|masthead|header|cookies?|consent|gdpr|notice|alert|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|reply|replies|disqus|pagination|pager|toolbar|tags|copyright|legal|disclaimer|search|"
    r"contentinfo|navigation|complementary|skip)(?:$|[\s_-])",
    re.I,
)
#: Words counted in advance for a feature: outside the main text for furniture, inside it for all others.
PRIOR_OUT, PRIOR_IN = 200, 20
#: A feature whose log odds are below this holds furniture.
TELLING = -2.0
#: A tag costs this many words at most.
TAG_WORDS = 1.0
#: What costs next to nothing: furniture's words anywhere, tags within an article; it ends a region but doesn't part one.
LITTLE = -1e-6
#: At most this many labelled pages (least hashes of their ids first) are used to fit weights.
LABELLED = 400

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in RAW}
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is ``open``, ``close`` or ``text``; comments and raw elements are left out."""
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        if at > last:  # no tag can end any more: one that begins is dropped, with all behind it
            rest = re.split(r"<[a-zA-Z/!?]", page[at:], maxsplit=1)[0]
            if rest:
                yield "text", rest, ""
            return
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if page[m.start()] != "<" or at - m.start() == 1:
                yield "text", m[0], ""
            continue
        name, close = name.lower(), m[1] or m[4]
        if close:
            yield "close", name, ""
            continue
        rest = (m[3] if m[2] else m[6]) or ""
        if name in RAW and not rest.rstrip().endswith("/"):
            end = _END[name].search(page, at)
            at = end.end() if end else n
            continue
        yield "open", name, rest


def features(name: str, rest: str, inside: bool) -> list[str]:
    """What an element's start tag says of the words in it: its class, id and role words, and a name that marks furniture.

    ``inside``: within an article; a ``header`` there is the article's own.
    """
    found = []
    if name not in ("html", "body", "main", "article", "br"):
        found = [f".{w}" for m in _MARK.findall(rest) for w in next(filter(None, m), "").lower().split()]
        if "hidden" in rest.lower().split():
            found.append("hidden")
    if name in FURNITURE or name == "header" and not inside:
        found.append(name)
    return found


def known_furniture(feature: str) -> bool:
    """Is a feature counted as furniture in advance?"""
    return feature[0] != "." or bool(MARKS.search(feature[1:]))


class Token(NamedTuple):
    """A tag or a text of a page, the number of the innermost element with features around it, and whether an article is around it."""

    kind: str
    name: str
    around: int
    article: bool


class Element(NamedTuple):
    """Features of an element that those around it lack, the number of the next such element around it, and whether furniture is known around it."""

    own: tuple[str, ...]
    up: int
    furniture: bool


class Page(NamedTuple):
    tokens: list[Token]
    elements: list[Element]


def sequence(page: str) -> Page:
    """A page's tokens and elements, in time linear in it: an end tag without a start is found so at once, and what is closed is closed once."""
    out: list[Token] = []
    elements = [Element((), 0, False)]
    stack: list[tuple[str, int, bool]] = []  # name, element, is it an article
    places: dict[str, list[int]] = {}  # where the open elements of a name lie in the stack
    having: Counter = Counter()  # features of open elements
    held: list[int] = []  # where those lie that an end tag of a phrase doesn't close
    article, here = 0, 0
    for kind, name, rest in tokens(page):
        if kind == "open" and name not in VOID:
            art = name in ("article", "main")
            own = tuple(f for f in dict.fromkeys(features(name, rest, article > 0)) if not having[f])
            if own:
                elements.append(Element(own, here, elements[here].furniture or any(map(known_furniture, own))))
                here = len(elements) - 1
                having.update(own)
            if art or own and any(map(known_furniture, own)):
                held.append(len(stack))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, here if own else -1, art))
            article += art
        out.append(Token(kind, name, here, article > 0))
        if kind == "close" and (at := places.get(name)):
            if name in ("p", "b") and held and held[-1] > at[-1]:
                continue  # an unclosed phrase around an element doesn't close it
            depth = at[-1]
            while len(stack) > depth:
                gone, element, art = stack.pop()
                places[gone].pop()
                article -= art
                if element >= 0:
                    having.subtract(elements[element].own)
                    here = elements[element].up
            while held and held[-1] >= depth:
                held.pop()
    return Page(out, elements)


class Weights(NamedTuple):
    """Log odds: of a word, of tags (``p``, ``/p``), of features, and of words outside the article of a page that names one."""

    word: float
    tags: dict[str, float]
    features: dict[str, float]
    outside: float

    def furniture(self, feature: str) -> bool:
        return self.features[feature] < TELLING if feature in self.features else known_furniture(feature)


def counts(pages: Iterator[str | None]) -> Counter:
    """What weights are made of: (kind, name, main text or not) to a number, over the labelled pages among ``pages``."""
    found: Counter = Counter()
    for text in pages:
        page = sequence(text or "")
        if not any(t.article for t in page.tokens):
            continue
        held = ([0] * len(page.elements), [0] * len(page.elements))
        for t in page.tokens:
            main = t.article and not page.elements[t.around].furniture
            if t.kind != "text":
                found["tag", f"{'/' * (t.kind == 'close')}{t.name}", main] += 1
                continue
            n = len(t.name.split())
            held[main][t.around] += n
            found["word", "", main] += n
            if not t.article:  # by its label no such word is main text
                found["apart", "", False] += n
        for i in range(len(page.elements) - 1, 0, -1):  # elements within come after those around
            own, up, _ = page.elements[i]
            for main in (False, True):
                held[main][up] += held[main][i]
                found.update({("feature", f, main): held[main][i] for f in own})
    return found


def weigh(found: Counter) -> Weights:
    """Weights of the counts."""
    odds, tags = {}, {}
    word = max(0.5, math.log((found["word", "", True] + 1) / (found["word", "", False] + 1)))
    for kind, name, _ in list(found):
        main, rest = found[kind, name, True], found[kind, name, False]
        if kind == "feature":
            known = known_furniture(name)
            odds[name] = math.log((main + (PRIOR_IN, 1)[known]) / (rest + (1, PRIOR_OUT)[known]))
        elif kind == "tag":
            tags[name] = max(-TAG_WORDS * word, min(-0.01, math.log((main + 0.5) / (rest + 0.5)) - 1) if rest else -0.01)
    return Weights(word, tags, odds, -math.log(found["apart", "", False] + 1)) if found else DEFAULT_WEIGHTS


def fit_weights(pages: Iterator[str | None]) -> Weights:
    """Weights from labelled pages: those whose markup holds an ``article`` or ``main`` element."""
    return weigh(counts(pages))


#: Weights in use where no labelled page is at hand.
DEFAULT_WEIGHTS = Weights(1.0, {}, {}, TELLING - 1)


def scores(page: Page, weights: Weights) -> list[float]:
    """Each token's score; a text's is that of its words together."""
    apart = weights.outside < TELLING and any(t.article for t in page.tokens)
    bad = [False]
    for own, up, _ in page.elements[1:]:
        bad.append(bad[up] or any(map(weights.furniture, own)))
    out = []
    for t in page.tokens:
        if t.kind == "text":
            out.append(LITTLE if bad[t.around] or apart and not t.article else weights.word * len(t.name.split()))
        elif t.article:
            out.append(LITTLE)
        else:
            tag = f"{'/' * (t.kind == 'close')}{t.name}"
            out.append(weights.tags.get(tag, -weights.word if t.name in FURNITURE else -0.05))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """The contiguous run of the greatest sum, by one scan; ties go to the first, empty if none is above zero."""
    best, low, total, at, found = 0.0, 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(values):
        total += x
        if total - low > best:
            best, found = total - low, (at, i + 1)
        if total < low:
            low, at = total, i + 1
    return found


def region(page: Page, weights: Weights) -> list[tuple[int, int]]:
    """The content region as runs of tokens: the best contiguous run without the runs of negative words in it."""
    seq, values = page.tokens, scores(page, weights)
    start, end = best_run(values)
    while start < end and seq[start].kind != "text":  # a run begins and ends with words
        start += 1
    found, at = [], start
    for i in range(start, end):
        if seq[i].kind == "text" and values[i] < 0:
            found.append((at, i))
            at = i + 1
    found.append((at, end))
    return found


def extract(text: str | None, weights: Weights = DEFAULT_WEIGHTS) -> str:
    """The main text of one page; empty for a null page or one without text."""
    page = sequence(text or "")
    blocks, now = [], []
    for start, end in region(page, weights):
        for t in page.tokens[start:end]:
            if t.kind == "text":
                now.append(t.name)
            elif t.name in BLOCKS:
                blocks.append("".join(now))
                now = []
            elif t.name in ("br", "td", "th"):
                now.append(" ")
    blocks.append("".join(now))
    return "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


def main_text(pages: DataFrame, weights: Weights | None = None, labelled: int = LABELLED) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, from its whole ``html``.

    Without ``weights``, they are fitted on at most ``labelled`` pages that name
    their article (least hash of ``page_id`` first).  A null or empty page gives
    an empty text; repeated rows and null ids come back a row for a row.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if weights is None:
        named = narrow.where(F.lower("html").contains("<article") | F.lower("html").contains("<main"))
        sample = named.select("html", F.xxhash64("page_id").alias("h"), "page_id").orderBy("h", "page_id").limit(labelled).select("html")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in cut(batches, 0):
                found.update(counts(batch.column(0).to_pylist()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, n) for k, n in found.items())), (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["kind", "name", "main", "n"])

        # names of tags and class words with their counts, from so many pages; the pages stay where they are
        weights = weigh(Counter({(r.kind, r.name, r.main): r.n for r in sample.mapInArrow(count, "kind string, name string, main boolean, n long").collect()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 2):
            texts = [extract(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
