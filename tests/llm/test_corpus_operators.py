"""Near-duplicates, suffix dedup, packing, neighbours and classifier against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql.functions import col as spark_col
from pyspark.sql.functions import xxhash64 as spark_hash

from quarry.llm import ann_graph, packing, quality_classifier, simhash, suffix_dedup
from quarry.llm.queries import tokenizer

ODD = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one two three four"), (6, "One TWO three four"), (7, "é " * 3000), (8, "ab" * 600_000), (9, "same same"), (9, "same same"), (9, "other text")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, fp int, key int, doc int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(pairs):
    ids = sorted({i for i, _ in pairs})
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, fa in pairs:
        for b, fb in pairs:
            if a < b and (fa ^ fb).bit_count() <= 3:
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_fingerprints(spark, docs):
    for rows in (docs, frame(spark, [r for r in ODD if r[0] != 8])):
        want = Counter((r.doc_id, brute_fingerprint(r.text)) for r in rows.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.fp % 2**64) for r in simhash.fingerprints(rows).collect()) == want


def test_links_between_fingerprints(spark):
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(40)]
    prints = set(centers) | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for c in centers for _ in range(12)}
    pairs = list(enumerate(sorted(prints)))
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in pairs], "fp long, node long")
    for hot in (None, 0, 2, 20):  # how many fingerprints a half may have before it is dealt out changes nothing
        got = {r.node: r.component for r in simhash.components(simhash.links(table, hot=hot)).collect()}
        assert {i: got.get(i, i) for i, _ in pairs} == brute_components(pairs)


def test_several_fingerprints(spark):
    texts = [" ".join(f"w{(i * 31 + k * 7) % 97}" for k in range(30)) for i in range(6)] + ["", "one", None, "one"]
    rows = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: [x % 2**64 for x in r.fps] for r in simhash.fingerprints(rows, 3, (), 4).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert got[6] == got[8] == [0] * 4 and len(set(got[0])) == 4 and got[7] == got[9]
    # links across numbers of fingerprints, equal ones among them
    rng = random.Random(21)
    base = [[rng.getrandbits(64) for _ in range(3)] for _ in range(30)]
    sets = base + [[b[0] ^ 7, rng.getrandbits(64), rng.getrandbits(64)] for b in base[:8]] + [[rng.getrandbits(64), b[1], rng.getrandbits(64)] for b in base[4:12]] + [[rng.getrandbits(64), rng.getrandbits(64), b[0]] for b in base[20:24]]
    signed = [[x - 2**64 if x >= 2**63 else x for x in fps] for fps in sets]
    table = spark.createDataFrame([(i, fps) for i, fps in enumerate(signed)], "i int, fps array<long>")
    found = {r.i: r.component for r in table.withColumn("node", spark_hash("fps")).join(simhash.linked(table), "node").collect()}
    group = {}
    for i, x in enumerate(sets):
        near = {group[j] for j in group if any((p ^ q).bit_count() <= 3 for p, q in zip(x, sets[j]))} | {i}
        group[i] = min(near)
        group.update({j: min(near) for j, c in group.items() if c in near})
    assert len(set(found.values())) == len(set(group.values())) and all((found[i] == found[j]) == (group[i] == group[j]) for i in group for j in group)


def test_a_hot_half_is_dealt_out(spark):
    rng = random.Random(9)
    half = 0x9E3779B9 << 32
    prints = sorted({half | rng.getrandbits(32) for _ in range(400)} | {half ^ (1 << rng.randrange(32, 64)) | rng.getrandbits(8) for _ in range(200)})
    pairs = list(enumerate(prints))
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in pairs], "fp long, node long")
    want = brute_components(pairs)
    for hot in (None, 50):
        got = {r.node: r.component for r in simhash.components(simhash.links(table, hot=hot)).collect()}
        assert {i: got.get(i, i) for i, _ in pairs} == want


def test_components_through_rows_without_an_id(spark):
    prints = spark.createDataFrame([(1, 0b0), (None, 0b111), (2, 0b111111), (3, 0b111111 << 40)], "doc_id long, fp long")
    found = simhash.groups(prints)
    named = {r.id: r.component_fp for r in found.collect()}
    assert named[1] == named[2] == named[None] == 0 and named[3] != 0


@pytest.mark.parametrize("star", [simhash.STAR, 0])
def test_components_of_stars_and_chains(spark, star):
    rng = random.Random(17)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)] + [(5000, 5000)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), star).collect()}
    assert {x: got.get(x, x) for x in up} == {x: root(x) for x in up}


def test_links_of_large_variants(spark, monkeypatch):
    # a variant that more fingerprints share than are compared directly goes by balls instead, with the same links
    monkeypatch.setattr(simhash, "DIRECT", 4)
    rng = random.Random(13)
    centers = [rng.getrandbits(64) for _ in range(5)]
    pairs = list(enumerate(sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(60)})))
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in pairs], "fp long, node long")
    got = {r.node: r.component for r in simhash.components(simhash.links(table)).collect()}
    assert {i: got.get(i, i) for i, _ in pairs} == brute_components(pairs)


def test_large_buckets_are_joined_by_balls():
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)})
    forest = simhash.Forest(len(prints))
    simhash.ball_links(np.array(prints, np.uint64), np.arange(len(prints)), forest, step=1 << 15)
    want = brute_components(list(enumerate(prints)))
    assert dict(enumerate(forest.roots(np.arange(len(prints))).tolist())) == want


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert {c for (i, f), c in by.items() if f == 0} == {1}
    assert by[6, rows_fp(ODD[7][1])] == 5
    assert simhash.near_duplicates(frame(spark, [])).isEmpty()


def rows_fp(text):
    f = brute_fingerprint(text)
    return f - 2**64 if f >= 2**63 else f


def brute_dedup(rows, width=100):
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            part = data[s : s + width]
            if part in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(part)
        rest = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 50))]
        assert suffix_dedup.suffix_array(np.array(a)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])
    big = np.random.default_rng(0).integers(1, 4, 5000)
    order = suffix_dedup.suffix_array(big)
    assert sorted(order.tolist()) == list(range(5000)) and all(big[a : a + 40].tolist() <= big[b : b + 40].tolist() for a, b in zip(order[:300], order[1:301]))


@pytest.mark.parametrize("sizes", [{}, {"segment": 300, "large": 2, "chunk": 3000}, {"large": 12}])
def test_suffix_dedup_matches_brute_force(spark, docs, sizes):
    rng = random.Random(7)
    base = [r.text for r in docs.limit(40).collect()]
    rows = []
    for i in range(120):
        t, kind = rng.choice(base), rng.random()
        if kind < 0.3:
            t = t[: rng.randint(0, 400)] + rng.choice(base)[rng.randint(0, 100) :][: rng.randint(80, 160)] + t[-150:]
        elif kind < 0.45:
            t = rng.choice(["a" * rng.randint(90, 350), ("ab é" * 150)[: rng.randint(1, 500)], "", None])
        else:
            t = t[rng.randint(0, 30) :][: rng.randint(50, 1200)]
        rows.append((i * 3 - 50, t))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(frame(spark, rows), **sizes).collect()}
    assert got == brute_dedup(rows)


def test_a_hot_gram_is_dealt_out(spark):
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    noise = lambda n: letters[rng.integers(0, 27, n)].tobytes().decode()
    line = noise(95)  # shorter than a string, so that it is never removed by itself
    n = 100_000
    rows = frame(spark, [(i, noise(40) + line + noise(40)) for i in range(n)]).select(spark_col("doc_id").alias("doc"), "text").repartition(8).cache()
    hot = suffix_dedup.hot_keys(rows, 100, 40, 1 << 20, 1000)
    assert len(hot)
    scan = lambda keys: rows.mapInArrow(suffix_dedup._scan(100, 40, 1 << 20, keys), suffix_dedup._FOUND).where("shiftright(place, 9) & 127 > 0").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert scan(np.empty(0, np.uint64)) > 0.9 * n
    assert scan(hot) <= 5000  # that many strings share a byte and the line beside it
    part = rows.where("doc < 300").withColumnRenamed("doc", "doc_id")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(part, large=20).collect()}
    assert got == brute_dedup([(r.doc_id, r.text) for r in part.orderBy("doc_id").collect()])


def test_suffix_dedup_of_odd_rows(spark):
    long = "0123456789" * 30
    rows = [(None, long), (None, None), (5, long), (5, long), (5, "x" * 99), (6, "")]
    got = [(r.doc_id, r.n_removed) for r in suffix_dedup.dedup(frame(spark, rows)).collect()]
    # a null id comes first; rows that repeat id and text are one document, listed twice
    assert sorted(got, key=str) == sorted([(None, 290 - 90 + 90), (None, 0), (5, 300), (5, 300), (5, 0), (6, 0)], key=str)
    assert suffix_dedup.dedup(frame(spark, [])).isEmpty()


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())  # as it opens
    special = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>it's<|endoftext|>", "<|endof text|>", "<|ENDOFTEXT|> <|startoftext|>\n<|endoftext|>", "é<|endoftext|>\u2003x <|endoftext|", "x" * 50 + "<|endoftext|>" + "é" * 40]
    extra = frame(spark, [(10_000, None), (10_001, ""), (10_002, "İ ﬁne ① naïvé \x1c x y 日本 <|endoftext|> it's"), (10_003, "word " * 20_000), (10_003, "word " * 20_000), *enumerate(special, 10_010)])
    rows = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in rows.collect()}
    out = packing.pack(rows, tokenizer()).collect()
    cover = Counter()
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        cover[r.doc_id] += r.length
    assert cover == Counter({k: len(v) * (2 if k == 10_003 else 1) for k, v in ids.items()})
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096 and sum(fill.values()) / (4096 * len(fill)) > 0.95
    assert packing.pack(frame(spark, []), tokenizer()).isEmpty()


def test_packing_of_rows_that_share_an_id(spark):
    # of one id and as many tokens: only their ids tell the texts apart
    rows = frame(spark, [(1, f"{a} {b}") for a in ("cat", "dog", "sun", "sea") for b in ("red", "blue", "green")] * 3)
    runs = [packing.pack(rows.repartition(n), tokenizer(), capacity=8, quantum=2).collect() for n in (1, 3, 7)]
    for out in runs:
        fill = {}
        for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill.get(r.sequence_id, 0)
            fill[r.sequence_id] = r.offset + r.length
        assert max(fill.values()) <= 8
    assert Counter(map(tuple, runs[0])) == Counter(map(tuple, runs[1])) == Counter(map(tuple, runs[2]))


def test_cutting_stock_covers_demand():
    rng = np.random.default_rng(1)
    for n in (1, 7, 2000):
        demand = np.bincount(rng.integers(1, 65, n), minlength=65)
        plan = packing.solve(demand)
        packed = np.zeros(65, int)
        for pattern, copies in plan.patterns:
            assert sum(c * k for c, k in pattern.items()) <= 64
            for c, k in pattern.items():
                packed[c] += k * copies
        assert (packed == demand).all()
        assert sum(c for _, c in plan.patterns) <= np.ceil((demand * np.arange(65)).sum() / 64) * 1.05 + 2


def exact(vectors, k=5):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in ids[ids % 50 == 0].tolist():
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        out[q] = [i for _, i in sorted((-round(a, 9), i) for a, i in zip(s.tolist(), ids.tolist()) if i != q)[:k]]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[1000:1400] = x[1000] + rng.normal(size=(400, 24)) * 0.01  # a dense group
    x[2000:2900] = x[2000]  # a large group of copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann_graph.search(ann_graph.build(table, shard=700), table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact([(i, np.float32(v)) for i, v in rows])
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) / (5 * len(want)) >= 0.95
    assert got[2000] == [2001, 2002, 2003, 2004, 2005] and got[2050] == [2000, 2001, 2002, 2003, 2004]


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (50, [0.0, 0.0]), (100, [None, 1.0]), (150, None), (200, [float("nan"), 1.0]), (2, [float("inf"), 0.0]), (None, [1.0, 0.0]), (3, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_graph.search(ann_graph.build(table), table.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 3)] and got[1].score == -1.0
    none = spark.createDataFrame([], table.schema)
    assert ann_graph.search(ann_graph.build(none), none).isEmpty()


def test_neighbours_of_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], 9, 9)] * 6 + [(i, [1.0, 0.0], 9, 9) for i in (2, 3, 4, 5, 50)] + [(50, [1.0, 0.0], 9, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, shard int")  # names that the operator uses
    got = ann_graph.search(ann_graph.build(table), table.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(50, i, i, 1.0) for i in range(1, 6)]


def test_neighbours_keep_double_precision(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e-60, 0.0]), (2, [1e300, 0.0]), (3, [5e-324, 5e-324]), (4, [1e308, -1e308]), (5, [1.0, 1e-9]), (6, [1.0, 2e-9]), (7, [0.0, -0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_graph.search(ann_graph.build(table), table.where("vec_id = 0"), k=7).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(1, 1.0), (2, 1.0), (5, 1.0), (6, 1.0), (3, round(0.5**0.5, 12)), (4, round(0.5**0.5, 12))]


def test_neighbours_over_many_shards(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 8)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann_graph.build(table, shard=100)
    assert index.select("shard").distinct().count() == 8
    got: dict = {}
    for r in ann_graph.search(index, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows)
    columns = ("query_id", "rank", "vec_id", "score")
    whole, parted = (Counter(map(tuple, ann_graph.search(index, table.where("vec_id % 50 = 0"), block=n).select(*columns).collect())) for n in (100, 3))
    assert whole == parted and sum(whole.values()) == 80


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    rows = [r for r in quality_classifier.classify(docs, labels).collect()]
    again = quality_classifier.classify(docs.selectExpr("*", "1 as score", "2 as y", "3 as v", "'x' as kind", "0 as bucket"), labels.withColumnRenamed("toxic", "text"))  # names that the operator uses
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9


def test_classifier_never_reads_held_out_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    flipped = labels.selectExpr("doc_id", f"if({held}, cast(1 - quality as int), quality) as quality")
    a, b = (quality_classifier.fit(docs, x) for x in (labels, flipped))
    assert all(np.array_equal(p, q) for p, q in zip(a.layers, b.layers)) and a.temperature == b.temperature


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id long, quality int")
    rows = frame(spark, [(None, None), (1, "a b"), (1, ""), (3, "x " * 50_000)])
    assert {r.score for r in quality_classifier.classify(rows, none).collect()} == {0.5}
    assert {r.score for r in quality_classifier.classify(rows, one).collect()} == {1.0}
    assert quality_classifier.classify(frame(spark, []), one).isEmpty()
