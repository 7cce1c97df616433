"""License scans: exact phrases plus fuzzy short-notice search.

A notice of ``m`` characters that occurs with at most ``k`` edits contains at
least one of ``k + 1`` disjoint pieces of the notice unchanged (pigeonhole).
So the pieces are looked up as exact seeds first; only around a hit does the
``regex`` library's bounded-error matching verify the notice, count its edits
and report the span.

Texts are compared as words ``[0-9a-z and non-ASCII]+`` of the ASCII-lower-cased
text, joined by one space, so punctuation and line breaks inside a notice do
not count as edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut

#: Phrases that stand for a license by themselves.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Notice:
    """A short notice, its label and the edits (characters) it may carry."""

    label: str
    text: str
    edits: int
    whole: bool = False  # its ends must be words' ends, which a phrase this short needs


#: Notices that the fuzzy search looks for by default.
NOTICES = (
    Notice("gpl", "gnu general public license", 3),
    Notice("gpl", "licensed under the gnu general public license version", 5),
    Notice("apache", "apache license", 2, True),
    Notice("mit", "mit license", 1, True),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "mozilla public license version", 3),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
)

_SEPARATORS = bytes(c if chr(c).isdigit() and c < 0x3A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normalize(text: bytes) -> list[bytes]:
    """The words of a text, in order."""
    return text.lower().translate(_SEPARATORS).split()


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """``edits + 1`` disjoint pieces covering the notice, with their offsets."""
    n, k = len(notice.text), notice.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled seeds and verifiers of a set of notices."""

    def __init__(self, notices=NOTICES, phrases=BASE_PHRASES):
        self.notices = notices
        self.phrases = [(f" {p} ".encode(), label, p.count(" ") + 1) for p, label in phrases.items()]
        self.seeds = [[(at, piece.encode()) for at, piece in seeds(n)] for n in notices]
        # (?e): the first match of a place is bettered before the search goes on behind it
        bounds = [("(?<= )", "(?= )") if n.whole else ("", "") for n in notices]
        self.verify = [regex.compile(rf"(?e){a}(?:{regex.escape(n.text)}){{e<={n.edits}}}{b}") for n, (a, b) in zip(notices, bounds)]

    def exact(self, line: bytes) -> list[tuple[int, int, str]]:
        """(start word, end word, label) of every place of a phrase."""
        found = []
        for phrase, label, size in self.phrases:
            at, counted, word = line.find(phrase), 0, -1
            while at >= 0:
                word += line.count(b" ", counted, at + 1)
                counted = at + 1
                found.append((word, word + size, label))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) in characters of the normalised line.

        Every occurrence of every seed opens a window that holds the whole
        notice with its edits; windows that overlap are verified as one, from
        left to right, so every occurrence is met and the work is linear.
        """
        found = []
        for notice, pieces, verify in zip(self.notices, self.seeds, self.verify):
            spread, windows = len(notice.text.encode()) + 2 * notice.edits, []
            for at, piece in pieces:
                hit = line.find(piece)
                while hit >= 0:
                    windows.append((max(0, hit - at - 4 * notice.edits - 1), hit - at + spread + 4 * notice.edits + 1))
                    hit = line.find(piece, hit + 1)
            windows.sort()
            merged: list[list[int]] = []
            for a, b in windows:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            before = counted = 0  # characters before a byte
            for a, b in merged:
                while a and line[a] & 0xC0 == 0x80:  # to a character's first byte
                    a -= 1
                before, counted = before + len(line[counted:a].decode()), a
                window = line[a:b].decode(errors="ignore")
                found.extend((before + m.start(), before + m.end(), notice.label, sum(m.fuzzy_counts)) for m in verify.finditer(window))
        return found


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """Scan every whole text.

    Returns one row per input row: ``doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans``; ``spans`` is an array of
    ``(label, kind, start, end, edits)`` where base spans count words and fuzzy
    spans count characters of the normalised line.  ``score`` is 1 for an exact
    phrase, else one less the share of edits in the best notice's span, else 0.

    A null or empty text gives zero words, null first and last word, empty
    labels and score 0.  Null and repeated ids pass through, a row for a row.
    """
    scanner = []
    kinds = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not scanner:
            scanner.append(Scanner(notices, phrases))
        for batch in cut(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = normalize(text or b"")
                line = b" " + b" ".join(words) + b" "
                exact, fuzzy = scanner[0].exact(line), scanner[0].fuzzy(line)
                base = sorted({x[2] for x in exact})
                score = 1.0 if base else max([1 - e / (y - x) for x, y, _, e in fuzzy], default=0.0)
                rows.append((
                    doc_id, len(words), len(exact), min((x[0] for x in exact), default=None), max((x[0] for x in exact), default=None),
                    ",".join(base), ",".join(sorted({*base, *(x[2] for x in fuzzy)})), score,
                    [{"label": x[2], "kind": "phrase", "start": x[0], "end": x[1], "edits": 0} for x in exact] + [{"label": x[2], "kind": "notice", "start": x[0] - 1, "end": x[1] - 1, "edits": x[3]} for x in fuzzy],
                ))
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,kind:string,start:long,end:long,edits:int>>")
