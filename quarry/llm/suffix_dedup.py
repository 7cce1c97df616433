"""Suffix-array dedup of byte strings that occur twice, by a distributed difference-cover algorithm.

A corpus-wide suffix order is only needed among suffixes that share a prefix of
``WIDTH`` bytes, so the order is built in independent buckets:

1. *Bucket.*  The least hash among a string's ``GRAM``-grams is the same
   wherever the string occurs, so equal strings fall in the bucket of that gram
   (a minimizer).  Grams that occur once end here.  A gram that too many
   surroundings share is known before, by a count of all grams; its strings are
   dealt out by longer windows, so that no bucket meets in one task whole.
2. *Collapse.*  Occurrences of a gram with the same surroundings (everything a
   string through the gram can reach, compared by 96 bits of BLAKE2b over
   their bytes) are one; all but the first are removed.  Copies and long shared
   passages go this way, whatever their number, partly before the shuffle.
3. *Sort.*  Surroundings that differ are fetched, and each bucket sorts their
   suffixes by the difference-cover algorithm: triples at two of three places
   are sorted and named, the names' string is sorted by recursion, the
   remaining third is merged in by rank.
4. *Compare.*  Neighbours in suffix order that share ``WIDTH`` bytes, byte by
   byte, form runs; all but a run's first occurrence are removed.

Documents meet their removed intervals by a join on the document's number.

*Windows.*  The strings through a gram at ``at`` start from ``at - (WIDTH -
GRAM)`` to ``at``.  A range of starts is halved as often as needed; all strings
of a range share the bytes from its last start to its first end, and those bytes
(with the range's place in the halving, its ``path``) make the range's key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, gather, let_go, materialize, partitions

WIDTH = 100
GRAM = 40
#: Bytes hashed at a time.
SEGMENT = 1 << 20
#: A bucket with more surroundings than this is dealt out by windows before it is sorted.
LARGE = 4096
#: A gram is dealt out before the shuffle if more occurrences (collapsed piece by piece) hold it than LARGE and a
#: millionth of all, which bounds the list of such grams and what of one gram can meet in a task.
HOT_SHARE = 1 << 20
#: Distinct grams that a task counts at a time, at most.
COUNTED = 1 << 22
#: Halvings of a range of starts: in a large bucket, and until it is a single string.
DEEPER, DEEPEST = 3, 6
#: Symbols sorted at a time.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SCALES: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64th."""
    if not _SCALES or len(_SCALES[0]) < n:
        _SCALES[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(n, b, np.uint64)
            powers[0] = 1
            _SCALES.append(np.multiply.accumulate(powers))
    return _SCALES[0], _SCALES[1]


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values."""
    w = 1
    while 2 * w <= width:
        x = pick(x[:-w], x[w:])
        w *= 2
    return pick(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def _ranges(width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, from the gram's place, of the strings of every path; the path of a range's halves is twice its own, and one more."""
    low, high = np.zeros(2 << DEEPEST, np.int64), np.full(2 << DEEPEST, -1, np.int64)  # first after last: no such path
    low[1] = gram - width
    high[1] = 0
    for p in range(1, 1 << DEEPEST):
        if low[p] < high[p]:
            mid = (low[p] + high[p]) // 2
            low[2 * p], high[2 * p], low[2 * p + 1], high[2 * p + 1] = low[p], mid, mid + 1, high[p]
    return low, high


class Grams:
    """Grams of a few texts that are the least of some string of ``width`` bytes within its text.

    ``text`` and ``at`` (the text's number and the place in it), ``key`` and
    ``path`` of each; :meth:`deal` halves the ranges of some.
    """

    def __init__(self, blob: bytes, lengths: np.ndarray, width: int = WIDTH, gram: int = GRAM):
        data = np.frombuffer(blob, np.uint8)
        n, reach = len(data), width - gram
        self.blob, self.lengths, self.begin, self.width = blob, lengths, np.cumsum(lengths) - lengths, width
        self.low, self.high = _ranges(width, gram)
        self.up, self.down = _scales(max(n, 1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[:n], out=self.sums[1:])
        at, key = np.empty(0, np.int64), np.empty(0, np.uint64)
        text = np.repeat(np.arange(len(lengths)), lengths)
        if n >= width:
            grams = _mix((self.sums[gram:] - self.sums[:-gram]) * self.down[: n - gram + 1])
            least = _sliding(grams, reach + 1, np.minimum)
            least = np.where(text[: len(least)] == text[width - 1 :], least, np.uint64(0))
            edge = np.zeros(reach, np.uint64)
            most = _sliding(np.concatenate([edge, least, edge]), reach + 1, np.maximum)
            at = np.flatnonzero((grams == most) & (most != 0))
            key = grams[at]
        self.text, self.key, self.path = text[at], key, np.ones(len(at), np.int64)
        self.at = at - self.begin[self.text]

    def keep(self, which: np.ndarray) -> None:
        self.text, self.at, self.key, self.path = (x[which] for x in (self.text, self.at, self.key, self.path))

    def around(self, total: np.ndarray | None = None, offset: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings of each range begin and end in their texts; of a piece at ``offset`` of a text of ``total`` bytes, in the whole text."""
        total = self.lengths if total is None else total
        at = self.at if offset is None else self.at + offset[self.text]
        return np.maximum(at + self.low[self.path], 0), np.minimum(at + self.high[self.path] + self.width, total[self.text])

    def halve(self, which: np.ndarray) -> None:
        """Put both halves of some ranges in their place, so far as strings of them lie in the text."""
        text, at, path = (np.repeat(x[which], 2) for x in (self.text, self.at, self.path))
        path = 2 * path + np.arange(len(path)) % 2
        low, high = at + self.low[path], at + self.high[path]
        real = np.maximum(low, 0) <= np.minimum(high, self.lengths[text] - self.width)
        text, at, path, low, high = (x[real] for x in (text, at, path, low, high))
        first, last = self.begin[text] + high, self.begin[text] + low + self.width  # the bytes that all strings of the range share
        key = _mix(((self.sums[last] - self.sums[first]) * self.down[first]) ^ _mix(path.astype(np.uint64) + np.uint64(_BASE)))
        self.text, self.at, self.path, self.key = (np.concatenate((old[~which], new)) for old, new in ((self.text, text), (self.at, at), (self.path, path), (self.key, key)))

    def among(self, hot: np.ndarray) -> np.ndarray:
        """Which keys are among ``hot`` (sorted)."""
        return hot[np.minimum(np.searchsorted(hot, self.key), len(hot) - 1)] == self.key if len(hot) else np.zeros(len(self.key), bool)

    def single(self) -> np.ndarray:
        """Which ranges are a single string."""
        return self.low[self.path] == self.high[self.path]

    def deal(self, hot: np.ndarray) -> None:
        """Halve the ranges whose keys are among ``hot`` (sorted), again while halves are."""
        for _ in range(DEEPEST):
            which = self.among(hot) & ~self.single()
            if not which.any():
                return
            self.halve(which)

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A cheaper stand-in for :meth:`digests`, for counts that need not be exact."""
        first, last = self.begin[self.text] + low, self.begin[self.text] + high
        return _mix(((self.sums[last] - self.sums[first]) * self.down[first]) ^ self.key)

    def digests(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of BLAKE2b over the bytes from ``low`` to ``high`` of each gram's text, as a long and an int."""
        blob, digest = self.blob, hashlib.blake2b
        begin = self.begin[self.text]
        found = b"".join([digest(blob[a:b], digest_size=12).digest() for a, b in zip((begin + low).tolist(), (begin + high).tolist())])
        words = np.frombuffer(found, np.int32).reshape(-1, 3)
        return np.ascontiguousarray(words[:, :2]).view(np.int64).ravel(), words[:, 2].astype(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of an integer string with values from 1 up, by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.uint64)
    one = np.arange(1, n + (n % 3 == 1), 3)  # a sentinel triple keeps both residues apart
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _names(t[sample], t[np.minimum(sample + 1, n + 2)], t[np.minimum(sample + 2, n + 2)])
    if names.max() < len(sample):
        order = suffix_array(names)
    else:
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_pair(t[zero], rank[zero + 1]))]  # no two are equal
    # how many sampled suffixes precede each of the others: both residues are sorted by keys that the others have too
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(_pair(t[ones], rank[ones + 1]), _pair(t[zero], rank[zero + 1]))
    heads = np.concatenate([_pair(t[twos], t[twos + 1]), _pair(t[zero], t[zero + 1])])
    _, heads = np.unique(heads, return_inverse=True)
    heads = heads.astype(np.uint64)
    before += np.searchsorted(_pair(heads[: len(twos)], rank[np.minimum(twos + 2, n + 2)]), _pair(heads[len(twos) :], rank[zero + 2]))
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zero))
    free = np.ones(n, bool)
    free[place] = False
    out[place], out[free] = zero, sample
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << np.uint64(32) | b


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of triples."""
    if int(max(a.max(), b.max(), c.max())) < 1 << 21:
        key = a << np.uint64(42) | b << np.uint64(21) | c
    else:
        key = _pair(np.unique(_pair(a, b), return_inverse=True)[1].astype(np.uint64), c)
    order = np.argsort(key)  # equal ones get one name, whatever their order
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
    return out


def repeats(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every ``width``-byte string in ``texts`` that also starts earlier in them.

    ``texts[i]`` stands in document ``docs[i]`` from ``starts[i]`` on; texts may overlap.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum()) + len(texts)
    data = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
    at = np.cumsum(lengths + 1) - lengths - 1
    symbols = data[:total].astype(np.int64) + 1 + len(texts)
    symbols[at + lengths] = np.arange(1, len(texts) + 1)  # each text ends in a symbol of its own
    order = suffix_array(symbols)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    order = order[order + width <= (at + lengths)[owner[order]]]
    if len(order) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = np.arange(1, len(order))
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    for step in [*range(0, width - 7, 8), width - 8]:  # neighbours, eight bytes at a time
        same = same[words[order[same - 1] + step] == words[order[same] + step]]
    new = np.ones(len(order), bool)  # begins a run
    new[same] = False
    several = ~new
    several[:-1] |= several[1:]
    number, order = np.cumsum(new)[several], order[several]  # runs of one string need no look
    text = owner[order]
    doc, start = docs[text], starts[text] + order - at[text]
    first = np.lexsort((start, doc, number))
    number, doc, start = number[first], doc[first], start[first]
    head = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.empty(0, np.int64)
    least = np.repeat(head, np.diff(np.concatenate((head, [len(number)]))))
    later = (doc != doc[least]) | (start != start[least])
    return doc[later], start[later]


def _intervals(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals, by document."""
    if not len(doc):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    change = np.concatenate(([True], doc[1:] != doc[:-1]))
    # within a document the furthest end so far: lift each document above those before it
    lift = np.cumsum(change) * (int(high.max()) + 1)
    far = np.maximum.accumulate(high + lift) - lift
    new = change | np.concatenate(([True], low[1:] > far[:-1]))
    head = np.flatnonzero(new)
    return doc[head], low[head], far[np.concatenate((head[1:], [len(doc)])) - 1]


def _classes(key: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one key and digest side by side: their order, where classes begin, and the class of each."""
    order = np.argsort(one)  # a digest's first 64 bits part all but a few by themselves
    k, a, b = key[order], one[order], two[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1]))) if len(order) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _firsts(key: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of the least (doc, place) of each class, and all rows that lie elsewhere than their class's first."""
    order, head, number = _classes(key, one, two)
    if not len(order):
        return order, order
    d, x = doc[order], low[order]
    least = np.minimum.reduceat(d, head)[number]
    place = np.where(d == least, x, np.iinfo(np.int64).max)
    at = np.minimum.reduceat(place, head)[number]
    again = (d != least) | (x != at)
    kept = np.flatnonzero(~again)
    kept = kept[np.unique(number[kept], return_index=True)[1]]
    return order[kept], order[again]


#: ``key, one, two`` (the surroundings' digest), ``doc, place`` of a range of strings: its gram's place, path and surroundings' length.
#: An interval to remove has the path 0, and its end in ``one``.
_FOUND = "key long, one long, two int, doc long, place long"
_NAMES = ["key", "one", "two", "doc", "place"]


def _batch(key, one, two, doc, at, path, span) -> pa.RecordBatch:
    columns = [np.asarray(key).view(np.int64), one, two.astype(np.int32), doc, at << 16 | path << 9 | span]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_NAMES)


def _removals(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int64)
    return _batch(_mix(doc.astype(np.uint64) + low.astype(np.uint64)), high, none, doc, low, none, none)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram's place, the path, the surroundings' length."""
    return place >> 16, place >> 9 & 127, place & 511


def _pieces(batches: Iterator[pa.RecordBatch], width: int, segment: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes, np.ndarray]]:
    """Texts in groups of about two segments: (document, offset, whole length) of each piece, the bytes, the pieces' lengths.

    A long text comes in pieces that overlap by what a gram's surroundings reach.
    """
    held, parts, size = [], [], 0
    for batch in cut(batches):
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            if text is None or len(text) < width:
                continue
            for a in range(0, len(text), segment) if len(text) > segment else (0,):
                low = max(0, a - 2 * width)
                part = text if len(text) <= segment else text[low : a + segment + 2 * width]
                held.append((doc, low, len(text)))
                parts.append(part)
                size += len(part)
                if size >= 2 * segment:
                    yield held, b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
                    held, parts, size = [], [], 0
    if held:
        yield held, b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))


class Group:
    """The grams of a group of pieces, in terms of their documents."""

    def __init__(self, held: list[tuple[int, int, int]], blob: bytes, lengths: np.ndarray, width: int, gram: int):
        self.grams = Grams(blob, lengths, width, gram)
        self.doc, self.offset, self.total = (np.array([x[i] for x in held], np.int64) for i in range(3))
        # what a piece of a long text knows of surroundings is whole away from its ends
        low, high = self.reach()
        begin = self.offset[self.grams.text]
        self.grams.keep((low >= begin) & (high <= begin + lengths[self.grams.text]))

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings of each range begin and end in their documents."""
        return self.grams.around(self.total, self.offset)

    def distinct(self) -> np.ndarray:
        """The keys of ranges of different surroundings."""
        low, high = self.reach()
        begin = self.offset[self.grams.text]
        _, first = np.unique(self.grams.hashes(low - begin, high - begin), return_index=True)
        return self.grams.key[first]


def _scan(width: int, gram: int, segment: int, hot: np.ndarray):
    """Documents to ranges of strings, each class of equal surroundings once in a group, and to intervals to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, blob, lengths in _pieces(batches, width, segment):
            group = Group(held, blob, lengths, width, gram)
            grams = group.grams
            grams.deal(hot)
            low, high = group.reach()
            begin = group.offset[grams.text]
            one, two = grams.digests(low - begin, high - begin)
            doc, at = group.doc[grams.text], grams.at + begin
            kept, again = _firsts(grams.key, one, two, doc, low)
            yield _batch(*(x[kept] for x in (grams.key, one, two, doc, at, grams.path, high - low)))
            if len(again):
                yield _removals(*_intervals(doc[again], low[again], high[again]))

    return run


def _count(width: int, gram: int, segment: int, hot: np.ndarray):
    """Documents to ``key, n``: how often a task met each gram, where more than once; key null: all of them.

    With ``hot`` grams, their ranges at every level of halving are counted instead.
    Counts beyond ``COUNTED`` keys lose the rarest, and the rest as much as the
    greatest of those, so what is missed of any key is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        waiting: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, counts
            met = np.concatenate([keys, *waiting])
            n = np.concatenate([counts, np.ones(len(met) - len(keys), np.int64)])
            waiting.clear()
            order = np.argsort(met)
            met, n = met[order], n[order]
            head = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1]))) if len(met) else np.empty(0, np.int64)
            keys, counts = met[head], np.add.reduceat(n, head) if len(head) else n
            if len(keys) > COUNTED:
                least = np.partition(counts, len(keys) - COUNTED // 2)[len(keys) - COUNTED // 2]
                keys, counts = keys[counts > least], counts[counts > least] - least

        for held, blob, lengths in _pieces(batches, width, segment):
            group = Group(held, blob, lengths, width, gram)
            if len(hot):
                group.grams.keep(group.grams.among(hot))
            for _ in range(DEEPEST if len(hot) else 1):
                if len(hot):
                    group.grams.keep(~group.grams.single())
                    group.grams.halve(np.ones(len(group.grams.key), bool))
                waiting.append(group.distinct())
                total += len(waiting[-1])
            if sum(map(len, waiting)) >= COUNTED:
                merge()
        merge()
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array([*keys[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), total], pa.int64())], names=["key", "n"])

    return run


def hot_keys(texts: DataFrame, width: int, gram: int, segment: int, large: int) -> np.ndarray:
    """Sorted keys of grams that too many occurrences share, and of the ranges below them that still do; a few million at most."""
    found, whole = np.empty(0, np.uint64), 0
    for _ in ("grams", "ranges of hot grams"):
        counted = materialize(texts.mapInArrow(_count(width, gram, segment, found), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")), "counts")
        every = counted.where("key is null").first()
        if every is None:
            break
        whole = whole or every.n
        most = max(large, whole // HOT_SHARE, 4 * every.tasks)
        # a task leaves out what it met once, and what it lost beyond its bound
        more = counted.where(F.col("key").isNotNull() & (F.col("n") > most - every.tasks - whole // (COUNTED // 2))).select("key").toPandas()["key"].to_numpy(np.int64)
        if not len(more):
            break
        found = np.sort(np.concatenate((found, more.view(np.uint64))))
    return found


def _collapse(width: int, gram: int, large: int):
    """Rows of a bucket to intervals (path 0) and to surroundings that must be sorted (``one``: 1 if the bucket is large)."""
    start, _ = _ranges(width, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gather(batches)
        if table is None:
            return
        key, one, two, doc, place = (table.column(i).to_numpy() for i in range(5))
        at, path, span = _unpacked(place)
        done = path == 0
        removed = [(doc[done], at[done], one[done])]
        key, one, two, doc, at, path, span = (x[~done] for x in (key, one, two, doc, at, path, span))
        low = np.maximum(at + start[path], 0)
        kept, again = _firsts(key, one, two, doc, low)
        removed.append((doc[again], low[again], (low + span)[again]))
        yield _removals(*_intervals(*(np.concatenate(x) for x in zip(*removed))))
        key, doc, at, path, span = (x[kept] for x in (key, doc, at, path, span))
        order = np.argsort(key)
        head = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate((head, [len(key)])))
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(sizes, sizes)
        several = count > 1
        key, doc, at, path, span, count = (x[several] for x in (key, doc, at, path, span, count))
        yield _batch(key, (count > large).astype(np.int64), np.zeros(len(key), np.int64), doc, at, path, span)

    return run


def _fetch(width: int, gram: int):
    """Documents with the places asked of them to (bucket, document, start, bytes); those of a large bucket dealt out by windows."""
    first, last = _ranges(width, gram)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def below(path: int) -> list[int]:
        paths = [path]
        for _ in range(DEEPER):
            paths = [q for p in paths for q in ((2 * p, 2 * p + 1) if 2 * p < len(first) and first[2 * p] <= last[2 * p] else (p,))]
        return paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in cut(batches, size=1 << 20):
            lists = batch.column(2)
            ends, asked = lists.offsets.to_pylist(), lists.values
            for doc, text, a, b in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), ends, ends[1:]):
                for begin in range(a, b, 1 << 14):
                    part = asked.slice(begin, min(b - begin, 1 << 14))
                    at, path, span = _unpacked(part.field(2).to_numpy())
                    low = np.maximum(at + first[path], 0)
                    for key, large, x, p, start, end in zip(part.field(0).to_pylist(), part.field(1).to_pylist(), at.tolist(), path.tolist(), low.tolist(), (low + span).tolist()):
                        if not large:
                            out.append((key, doc, start, text[start:end]))
                            continue
                        for q in below(p):
                            start, end = max(x + int(first[q]), 0), min(x + int(last[q]), len(text) - width)
                            if start <= end:
                                name = hashlib.blake2b(b"%d " % q + text[x + int(last[q]) : x + int(first[q]) + width], digest_size=8).digest()
                                out.append((int.from_bytes(name, "little", signed=True), doc, start, text[start : end + width]))
                    if len(out) >= 1 << 15:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "doc", "start", "bytes"])
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "doc", "start", "bytes"])

    return run


def _sort(width: int, chunk: int):
    """Buckets to the intervals that their suffix order removes.

    Rows come sorted by bucket, document and start.  Equal texts of a bucket are
    one, the first; the others are removed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, starts, texts, size = [], [], [], 0
        key, seen = None, {}
        again: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal docs, starts, texts, size, again
            doc, start = repeats(texts, np.array(docs, np.int64), np.array(starts, np.int64), width)
            more = np.array(again, np.int64).reshape(-1, 3)
            docs, starts, texts, size, again = [], [], [], 0, []
            d, a, b = _intervals(*(np.concatenate(x) for x in ((doc, more[:, 0]), (start, more[:, 1]), (start + width, more[:, 2]))))
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "low", "high"])

        for batch in batches:
            for k, d, s, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k != key:
                    if size >= chunk:
                        yield flush()
                    key, seen = k, {}
                if seen.setdefault(t, (d, s)) != (d, s):
                    again.append((d, s, s + len(t)))
                elif not texts or (docs[-1], starts[-1], texts[-1]) != (d, s, t):
                    docs.append(d)
                    starts.append(s)
                    texts.append(t)
                    size += len(t)
        if texts:
            yield flush()

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """``doc`` (its place in document order), ``text`` and, where it differs, ``doc_id``.

    Where ids are whole (none null, none twice) the id itself is the number.
    Else distinct (id, text hash) pairs are ranked: a null id comes first, rows
    that repeat both are one document.  Ranks are counted range by range: within
    a range in parallel, and only the ranges' sizes are added up.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = rows.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not twice:
        return rows.select(F.col("doc_id").alias("doc"), "text").where("doc is not null")
    rows = rows.withColumn("_h", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_h")]
    pairs = rows.select("doc_id", "_h").distinct().repartitionByRange(partitions(spark), *order).withColumn("_p", F.spark_partition_id())
    pairs = materialize(pairs, "pairs")
    sizes = pairs.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    ranks = pairs.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(before), "_p")
    ranks = ranks.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), (F.col("_before") + F.col("_i") - 1).alias("doc"))
    ranks = materialize(ranks, "ranks")
    return rows.join(ranks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g"))).select("doc", "doc_id", "text")


def removed(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, segment: int = SEGMENT, large: int = LARGE, chunk: int = CHUNK) -> DataFrame:
    """``doc, low, high``: bytes to remove from each document of :func:`numbered`; intervals may overlap."""
    spark = rows.sparkSession
    parts = partitions(spark)
    texts = rows.select("doc", "text")
    hot = hot_keys(texts, width, gram, segment, large)
    found = texts.mapInArrow(_scan(width, gram, segment, hot), _FOUND).repartition(parts, "key").mapInArrow(_collapse(width, gram, large), _FOUND)
    found = materialize(found, "grams")
    let_go(spark)
    range_ = F.expr("shiftright(place, 9) & 127") > 0
    asked = found.where(range_).groupBy("doc").agg(F.collect_list(F.struct("key", "one", "place")).alias("asked"))
    pieces = texts.join(asked.where("doc is not null").hint("shuffle_hash"), "doc").select("doc", "text", "asked").mapInArrow(_fetch(width, gram), "key long, doc long, start long, bytes binary")
    sorted_ = pieces.repartition(parts, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(_sort(width, chunk), "doc long, low long, high long")
    return found.where(~range_).select("doc", F.shiftright("place", 16).alias("low"), F.col("one").alias("high")).unionByName(sorted_)


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = True, **sizes: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row and, with ``texts``, ``kept`` (the bytes left, as binary) and ``spans``.

    A byte goes if some ``width``-byte string over it starts earlier as well: in
    a document before (by id) or before in the same one.  A null text is empty;
    a text shorter than ``width`` stays whole.  ``sizes`` sets the working sizes
    ``segment``, ``large`` and ``chunk``, which change no result.
    """
    rows = numbered(docs)
    cuts = removed(rows, width, gram, **sizes).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    # with ids as numbers both joins read the same two columns of the texts, so their exchange is made once
    ids = "doc_id" if "doc_id" in rows.columns else "doc"
    joined = rows.join(cuts.hint("shuffle_hash"), "doc", "left").select(F.col(ids).alias("doc_id"), "text", "cuts")
    fields = [("doc_id", "long", pa.int64()), ("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    if texts:
        fields += [("kept", "binary", pa.binary()), ("spans", "array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            out = []
            for doc_id, text, cuts in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                spans, kept, at = [], [], 0
                for a, b in sorted((x["low"], x["high"]) for x in cuts or ()):
                    if spans and a <= spans[-1]["end"]:
                        spans[-1]["end"] = max(b, spans[-1]["end"])
                    else:
                        spans.append({"start": a, "end": b})
                for x in spans:
                    kept.append(text[at : x["start"]])
                    at = x["end"]
                rest = b"".join([*kept, text[at:]])
                out.append((doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest, spans)[: len(fields)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*out), fields)], names=[n for n, _, _ in fields])

    return joined.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))
