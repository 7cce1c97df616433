"""Packing documents into sequences by cutting-stock column generation.

Documents are tokenised once; a document beyond a sequence's capacity is cut
into full sequences and a rest, others stay whole.  The histogram of piece
lengths, in classes of a few tokens, has a bounded size whatever the corpus:
over it a linear program is solved whose columns (patterns of classes that fit
one sequence) are priced by a knapsack dynamic program.  Pattern counts are
rounded down and the small rest is packed best-fit.  Pieces are ranked within
their class; the rank alone says which pattern, which of its copies and which
slot a piece gets, so assignment is one scan.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .words import encode, groups

CAPACITY = 4096
END = 2
#: Tokens per length class of the linear program.
QUANTUM = 8
#: The linear program ends when its bound proves it within this share of the optimum.
GAP = 5e-4
#: Distinct words that a worker remembers.
CACHE = 150_000

# Text of these characters needs no composition and folds case character by character.
_SAFE = re.compile(r"[\x21-\x7e\xa1-\xff]*")
_L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
# Fixed value: the vocabulary's split pattern, for lower-case text of the characters above.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


class WordTokenizer:
    """Token ids of single words (white space separates words in this vocabulary), as packed unsigned 32-bit ids.

    A word of plain characters is cut by the vocabulary's own pattern and only
    pieces not met before are run through the model; any other word, and one
    that holds a special token's text, goes through the whole tokenizer as it
    opens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a special token stands for itself wherever its text occurs; none holds white space
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in special for c in t):
            raise ValueError("words are encoded one by one, so a special token may not hold white space")
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.IGNORECASE)
        self.opening = os.path.commonprefix([t.lower() for t in special]) if special else "\0"
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in visible]
        self.alphabet = {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(others)}}

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            shown = text if text.isascii() else "".join(map(self.alphabet.__getitem__, text.encode()))
            ids = [t.id for t in self.tokenize(shown)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(text) <= 32:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def word(self, raw: bytes) -> bytes:
        found = self.words.get(raw)
        if found is None:
            if raw.isalpha():  # plain letters are one piece
                found = self.piece(raw.lower().decode())
            else:
                text = raw.decode()
                low = text.lower()
                if _SAFE.fullmatch(text) and not (self.opening in low and self.special.search(text)):
                    found = b"".join(map(self.piece, _PIECES.findall(low)))
                else:
                    found = struct.pack(f"<{len(ids)}I", *ids) if (ids := self.tokenizer.encode(text, add_special_tokens=False).ids) else b""
            if len(raw) <= 32:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[raw] = found
        return found


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: the documents' token ids, cut at multiples of ``capacity``."""
    made: list[WordTokenizer] = []
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(WordTokenizer(tokenizer))
        for table in groups(batches):
            codes, offsets, distinct = encode(table.column(1))
            known, word = made[0].words.get, made[0].word
            ids = [known(w) or word(w) for w in distinct] + [np.array([end], "<u4").tobytes()]
            codes = np.insert(codes, offsets[1:], len(distinct))  # the end token closes each document
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            starts, values = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
            ends = np.cumsum(sizes[codes])
            flat = values[np.repeat(starts[codes] - (ends - sizes[codes]), sizes[codes]) + np.arange(ends[-1])]
            last = ends[offsets[1:] + np.arange(len(offsets) - 1)]
            rows = []
            for doc_id, a, b in zip(table.column(0).to_pylist(), [0, *last[:-1].tolist()], last.tolist()):
                rows.extend((doc_id, at - a, min(capacity, b - at), zlib.crc32(flat[at : min(b, at + capacity)]), b - a) for at in range(a, b, capacity))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


@dataclass
class Plan:
    """Patterns (class -> count, copies) over ``capacity`` units; a class is a length in units, rounded up."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]]


def _price(y: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of the greatest dual value: an unbounded knapsack over the classes."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        values = y[1 : w + 1] + best[w - 1 :: -1]
        c = int(values.argmax())
        best[w], choice[w] = (values[c], c + 1) if values[c] > best[w - 1] else (best[w - 1], 0)
    w, found = capacity, {}
    while w > 0:
        c = int(choice[w])
        if c:
            found[c] = found.get(c, 0) + 1
        w -= c or 1
    return float(best[capacity]), found


def solve(demand: np.ndarray, gap: float = GAP) -> Plan:
    """Patterns that cover ``demand`` (pieces of each class, by class) with few sequences.

    A revised simplex with column generation; the basis has a row for each class
    in demand.  Ends at the optimum, or once the dual bound is within ``gap``.
    """
    capacity = len(demand) - 1
    classes = np.flatnonzero(demand)
    if not len(classes):
        return Plan(capacity, [])
    row = {int(c): i for i, c in enumerate(classes)}
    columns: list[dict[int, int]] = [{int(c): capacity // int(c)} for c in classes]
    inverse = np.diag([1.0 / (capacity // c) for c in classes.tolist()])
    x = inverse @ demand[classes].astype(float)
    while True:
        y = np.zeros(capacity + 1)
        y[classes] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = _price(y, capacity)
        pattern = {c: n for c, n in pattern.items() if c in row}
        if value <= 1 + 1e-9 or 1 - 1 / value < gap:
            break
        a = np.zeros(len(classes))
        for c, n in pattern.items():
            a[row[c]] = n
        step = inverse @ a
        ratio = np.full(len(step), np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-9)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        x -= step * ratio[r]
        x[r] = ratio[r]
        pivot = inverse[r] / step[r]
        inverse -= np.outer(step, pivot)
        inverse[r] = pivot
        columns[r] = pattern
    left, patterns = demand.astype(np.int64).copy(), []
    for pattern, n in sorted(zip(columns, x.tolist()), key=lambda p: -p[1]):
        copies = min([int(n + 1e-9), *(int(left[c]) // k for c, k in pattern.items())])
        if copies > 0:
            patterns.append((pattern, copies))
            for c, k in pattern.items():
                left[c] -= k * copies
    return Plan(capacity, patterns + _best_fit(left, capacity))


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Pack the rest, largest first, each into the fullest open sequence that has room; equal sequences are one pattern."""
    open_at: list[list[dict[int, int]]] = [[] for _ in range(capacity + 1)]
    done: list[dict[int, int]] = []
    for c in np.flatnonzero(left)[::-1].tolist():
        n = int(left[c])
        while n:
            room = next((r for r in range(c, capacity + 1) if open_at[r]), None)
            bin_ = open_at[room].pop() if room is not None else {}
            room = capacity if room is None else room
            k = min(n, room // c)
            bin_[c] = k
            n -= k
            room -= k * c
            (open_at[room] if room else done).append(bin_)
    counts: dict[tuple, int] = {}
    for b in [*done, *(b for r in open_at for b in r)]:
        key = tuple(sorted(b.items()))
        counts[key] = counts.get(key, 0) + 1
    return [(dict(k), n) for k, n in counts.items()]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, quantum: int = QUANTUM) -> DataFrame:
    """Pack all documents; a row for each piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``.  A null or empty text has the end token alone.  Repeated ids and
    null ids are documents of their own; an empty table gives no row.  Pieces
    are ranked by all their columns, so those that tie are equal and a stage
    that runs again places them alike.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, end), "pieces")
    units = -(-capacity // quantum)
    demand = np.zeros(units + 1, np.int64)
    # at most `units` rows, however large the corpus
    for r in cut.groupBy(F.ceil(F.col("length") / quantum).cast("int").alias("c")).count().collect():
        demand[r[0]] = r[1]
    plan = solve(demand)
    sequence, slots = 0, [[] for _ in range(units + 1)]
    for pattern, copies in plan.patterns:
        for c, k in pattern.items():
            slots[c].append((k, copies, sequence))
        sequence += copies
    table = []
    for found in slots:
        k, copies, first = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        table.append((np.cumsum(k * copies) - k * copies, k, first))

    # ranks within a class: counted in cells of class and hash, so that no class meets in one task
    cells = max(partitions(spark), int(demand.sum()) // 50_000 + 1)
    ranked = cut.withColumn("_c", F.ceil(F.col("length") / quantum).cast("int")).withColumn("_s", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)))
    before = ranked.groupBy("_c", "_s").agg(F.count("*").alias("n"))
    before = before.withColumn("_at", F.sum("n").over(Window.partitionBy("_c").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inner = F.row_number().over(Window.partitionBy("_c", "_s").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = ranked.withColumn("_i", inner).join(before, ["_c", "_s"]).withColumn("_rank", F.coalesce("_at", F.lit(0)) + F.col("_i") - 1).drop("_s", "_i", "_at")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rank = batch.column("_c").to_numpy(), batch.column("_rank").to_numpy()
            seq, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c).tolist():
                mine = np.flatnonzero(c == k)
                starts, size, first = table[k]
                p = np.searchsorted(starts, rank[mine], side="right") - 1
                inside = rank[mine] - starts[p]
                seq[mine], slot[mine] = first[p] + inside // size[p], inside % size[p]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(c.astype(np.int64)), pa.array(seq), pa.array(slot)], names=[*names, "_c", "sequence_id", "_slot"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.mapInArrow(assign, ", ".join(f"{n} long" for n in [*names, "_c", "sequence_id", "_slot"]))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("_c"), "_slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).select(*names, "sequence_id", "offset")
