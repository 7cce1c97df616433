"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within three bits agree, on at least one of their two
32-bit halves, within one bit: half the radius, rounded down.  So every
fingerprint emits, for each half, all variants within that distance, rows are
shuffled on the variants, and colliding pairs are verified over all 64 bits.
A pair at distance one has one half of odd and one of even parity; only odd
halves need flip a bit, which meets every even half at its own value and saves
half the variants.

A half that many fingerprints share is dealt out over tasks by the same rule
once more: of the other half's two quarters, one agrees within one bit.  What
then still meets at one variant (at most the 65,536 values of the last quarter
and their neighbours) is joined inside its task by the 64-bit ball of the same
kind, so the work stays linear in the group, and a task sends on a spanning
forest of its links, never all pairs.  Components are then found by alternating
large-star and small-star steps over the links of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, done_with, gather, let_go, materialize, partitions

SEED = 42
#: Colliding fingerprints of a task are compared directly up to this many per variant.
DIRECT = 512
#: A half is dealt out by quarters if more fingerprints hold it than this, and than a ten-thousandth of all: at most 20,000 halves.
HOT, HOT_SHARE = 4096, 10_000
#: Links beyond which one node's may be too many for a task.
STAR = 10_000_000


def _stirred(x: np.ndarray) -> np.ndarray:
    """A second hash of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int = 3, prints: int = 1) -> list[int]:
    """The 64-bit SimHash of a text's word shingles, repeats included; beyond the first, by further hashes of the shingles' hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return [0] * prints
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        hashes = np.array([digest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())), np.uint64, n - size + 1)
    return [_majority(hashes if j == 0 else _stirred(hashes + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) for j in range(prints)]


def fingerprints(docs: DataFrame, size: int = 3, keep: tuple[str, ...] = (), prints: int | None = None) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a signed long) of every row, and the columns in ``keep``; with ``prints``, an array ``fps`` of so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = prints or 1
        for batch in cut(batches):
            texts = as_bytes(batch.column(1))
            found = pa.array(np.array([x for t in texts for x in fingerprint(t or b"", size, n)], np.uint64).view(np.int64))
            if prints:
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], names=["doc_id", "fps" if prints else "fp", *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep).mapInArrow(run, f"doc_id long, {'fps array<long>' if prints else 'fp long'}{kept}")


class Forest:
    """Union-find over 0..n-1; the root of a tree is its least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs: repeat minimum-label hooking until it is stable."""
        up = self.up
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            keep = ra != rb
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while (y := self.up[x]) is not None and (y != x).any():
            x = y
        return x


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def ball_links(fps: np.ndarray, rows: np.ndarray, forest: Forest, radius: int = 3, step: int = 1 << 22) -> None:
    """Join all of ``fps`` within three bits through variants of the whole word.

    Odd-parity words emit variants one bit away and even ones two bits away
    (a pair at distance one or three meets there); for distance two each emits
    one bit away.  Variants are taken in passes by their hash, so memory does
    not follow the number of words.
    """
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    two = np.concatenate(([np.uint64(0)], one[i] | one[j]))
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    size = len(fps) * 65 + int((~odd).sum()) * len(two)
    passes = max(1, -(-size // (step * 4)))
    for p in range(passes):
        keys, owners = [], []
        for at in range(0, len(fps), max(1, step // len(two))):
            part = slice(at, at + max(1, step // len(two)))
            for who, masks in ((np.ones(len(fps[part]), bool), one), (~odd[part], two)):
                key = (fps[part][who][:, None] ^ masks[None, :]).ravel()
                owner = np.repeat(np.arange(len(fps))[part][who], len(masks))
                mine = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(passes) == np.uint64(p)
                keys.append(key[mine])
                owners.append(owner[mine])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        # all words that meet at a variant lie within two bits of it; nearest first, each
        # links to those before it within the radius
        lag = 1
        while True:
            same = np.flatnonzero(key[lag:] == key[:-lag]) if lag < len(key) else np.empty(0, np.int64)
            if not len(same):
                break
            a, b = owner[same], owner[same + lag]
            near = (a != b) & (_apart(fps[a], fps[b]) <= radius)
            forest.add(rows[a[near]], rows[b[near]])
            lag += 1


def _by_quarters(rows: DataFrame, distinct: DataFrame, hot: int) -> DataFrame:
    """``rows (key, flip, fp, node)`` with the keys that many fingerprints share dealt out by the other half's quarters."""
    halves = distinct.select(F.explode(F.expr("array(print * 8589934592L + shiftrightunsigned(fp, 32), print * 8589934592L + 4294967296L + (fp & 4294967295L))")).alias("key"))
    halves = halves.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    if halves.isEmpty():
        return rows
    # rows whose half is one bit away flip to the key, and what flips away from it meets others at its neighbours
    reached = halves.select(F.explode(F.expr("if(bit_count(key & 4294967295L) % 2 = 1, concat(array(key), transform(sequence(0, 31), b -> key ^ shiftleft(1L, b))), array(key))")).alias("key"))
    reached = reached.distinct().withColumn("hot", F.lit(True))
    marked = rows.join(F.broadcast(reached), "key", "left")  # 33 rows for each of at most 2 * HOT_SHARE halves
    dealt = F.expr(
        "flatten(transform(array(shiftrightunsigned(if(shiftright(key, 32) % 2 = 1, shiftrightunsigned(fp, 32), fp & 4294967295L), 16), if(shiftright(key, 32) % 2 = 1, shiftrightunsigned(fp, 32), fp) & 65535L), (v, q) -> "
        "transform(if(bit_count(v) % 2 = 1, concat(array(v), transform(sequence(0, 15), b -> v ^ shiftleft(1L, b))), array(v)), x -> shiftleft(1L, 62) | shiftleft(key, 17) | shiftleft(cast(q as long), 16) | x)))"
    )
    return marked.select(F.explode(F.when(F.col("hot"), dealt).otherwise(F.array("key"))).alias("key"), "flip", "fp", "node")


def links(distinct: DataFrame, radius: int = 3, hot: int | None = None) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within the radius.

    ``distinct`` holds ``fp, node`` with unique ``fp``; with a column ``print``,
    fingerprints meet those of the same number only, and each is unique within
    it.  Not every linked pair is listed: what is left out is reached through the
    links of a forest.  ``hot`` is the number of fingerprints beyond which a
    shared half is dealt out; it changes no component.
    """
    if "print" not in distinct.columns:
        distinct = distinct.withColumn("print", F.lit(0))
    if radius != 3:
        raise ValueError("the halves and parities used here hold for three bits")
    spark = distinct.sparkSession
    variant = F.expr(
        "flatten(transform(array(shiftrightunsigned(fp, 32), fp & 4294967295L), (v, half) -> concat("
        "array(named_struct('key', print * 8589934592L + half * 4294967296L + v, 'flip', false)),"
        "if(bit_count(v) % 2 = 1, transform(sequence(0, 31), b -> named_struct('key', print * 8589934592L + half * 4294967296L + (v ^ shiftleft(1L, b)), 'flip', true)), array()))))"
    )
    rows = distinct.select("fp", "node", F.explode(variant).alias("v")).select(F.col("v.key").alias("key"), F.col("v.flip").alias("flip"), "fp", "node")
    rows = _by_quarters(rows, distinct, max(HOT, distinct.count() // HOT_SHARE) if hot is None else hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gather(batches)
        if table is None:
            return
        key, flip, fp, node = (table.column(i).to_numpy() for i in range(4))
        order = np.argsort(key, kind="stable")
        key, flip, fp, node = key[order], flip[order], fp[order].view(np.uint64), node[order]
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        key, flip, fp, node = key[shared], flip[shared], fp[shared], node[shared]
        if not len(key):
            return
        names, row = np.unique(node, return_inverse=True)
        forest = Forest(len(names))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        small = np.repeat(sizes <= DIRECT, sizes)
        lag, left = 1, np.flatnonzero(small)
        k, f, w, r = key[left], fp[left], flip[left], row[left]
        while True:
            same = np.flatnonzero(k[lag:] == k[:-lag]) if lag < len(k) else np.empty(0, np.int64)
            if not len(same):
                break
            near = ~(w[same] & w[same + lag]) & (_apart(f[same], f[same + lag]) <= radius)
            forest.add(r[same[near]], r[same[near] + lag])
            lag += 1
        for at, n in zip(starts[sizes > DIRECT].tolist(), sizes[sizes > DIRECT].tolist()):
            words, first = np.unique(fp[at : at + n], return_index=True)
            ball_links(words, row[at : at + n][first], forest, radius)
        root = forest.roots(np.arange(len(names)))
        moved = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[root[moved]]), pa.array(names[moved])], names=["a", "b"])

    return rows.repartition(partitions(spark), "key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, star: int = STAR) -> DataFrame:
    """``node, component``: the least node that each node of ``edges (a, b)`` reaches.

    Large-star and small-star steps alternate until no link moves; each step
    aggregates partially before its shuffle, and links are written to the
    shared folder between rounds.  With more than ``star`` links a node may have
    more rays than a task should join: minima are then written too, so that both
    sides of a join are plain shuffles, which adaptive execution divides.
    """
    links = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, size = None, links.count()
    while True:
        written: list[DataFrame] = []

        def kept(df: DataFrame) -> DataFrame:
            if size > star:
                written.append(df := materialize(df, "star"))
            return df

        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = materialize(small, "links", over=links)
        done_with(*written)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, size = now, now[0]


def groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``fp, id, component_fp`` for every distinct fingerprint of ``prints (doc_id, fp)``: its least id and its group's least fingerprint.

    Fingerprints themselves are linked, whatever ids carry them: an id that comes
    with several texts joins no groups, and null ids keep none apart.
    """
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    reach = components(links(distinct.select("fp", F.col("fp").alias("node")), radius)).withColumnRenamed("node", "fp")
    return distinct.join(reach, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component_fp"))


def linked(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``node, component`` of every distinct row of fingerprints in ``prints (fps)``; ``node`` is the hash of the row.

    Rows are linked where fingerprints of one number lie within the radius.  One
    fingerprint of 64 bits meets a near copy by chance, and several, each by other
    hashes, meet it the surer.
    """
    spark = prints.sparkSession
    distinct = materialize(prints.select(F.xxhash64("fps").alias("node"), "fps").groupBy("node").agg(F.any_value("fps").alias("fps")), "distinct")
    each = distinct.select("node", F.posexplode("fps").alias("print", "fp"))
    first = materialize(each.groupBy("print", "fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "firsts")
    same = each.withColumnRenamed("node", "b").join(first.where("n > 1").withColumnRenamed("node", "a"), ["print", "fp"]).where("a <> b").select("a", "b")
    near = materialize(links(first.select("print", "fp", "node"), radius), "near")
    let_go(spark)
    reach = components(same.unionByName(near))
    return distinct.select("node").join(reach, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Texts without a word (null, empty, white space) have the fingerprint zero
    and are linked like any other.  ``component_id`` is the least id of the
    row's group, or null where no id of the group is known.
    Repeated rows come back as often as they came; an empty table gives none.
    """
    prints = materialize(fingerprints(docs, size), "prints")
    found = groups(prints, radius)
    # a table of its own, so that the join on it can divide a large group
    least = materialize(found.groupBy("component_fp").agg(F.min("id").alias("component_id")), "least")
    named = found.join(least, "component_fp").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
