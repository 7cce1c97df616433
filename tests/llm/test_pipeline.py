"""The pipeline's stages, each on its own input, and its queries in the driver's contract."""

from collections import Counter

import corpus_pipeline as pipeline
from quarry.llm import quality_classifier, secret_scan, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        steps[name] = (docs, out)
        docs = out
    before, after = steps["quality classifier"]
    verdict = {r.doc_id: r.predicted for r in quality_classifier.classify(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {k for k, v in verdict.items() if v}
    before, after = steps["simhash near-dedup"]
    prints = [(r.doc_id, simhash.fingerprint((r.text or "").encode(), pipeline.SHINGLE, pipeline.PRINTS)) for r in before.collect()]
    left: dict = {}  # by brute force: links between any two documents, and the least id of each group
    for a, x in prints:
        near = {left[b] for b, y in prints if b in left and any((p ^ q).bit_count() <= 3 for p, q in zip(x, y))} | {a}
        left[a] = min(near)
        left.update({b: min(near) for b, c in left.items() if c in near})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(left.values()))
    before, after = steps["secret scan"]
    assert after.count() == before.count() and after.columns == list(pipeline.COLUMNS)
    assert secret_scan.digest(secret_scan.scan(after)).where("n_assign + n_access + n_hex > 0").isEmpty()
    clean = {r.doc_id: r.text for r in before.collect() if r.text in {x.text for x in after.collect()}}
    assert len(clean) >= before.count() - 20
    before, after = steps["mixing to weights"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect()) and after.columns == list(pipeline.COLUMNS)
    before, after = steps["packing"]
    copies = Counter(r.doc_id for r in before.collect())
    assert Counter(r.doc_id for r in after.where("start = 0").collect()) == copies


def test_repeated_rows_leave_one(spark):
    text = "a few words that come twice in this table of documents"
    docs = spark.createDataFrame([(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text, "en", "s", 9), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str) == [1, None]


def test_near_copies_leave_one(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    near, far = words.copy(), words.copy()
    near[200] = "changed"  # 5 of 396 shingles: a similarity of 0.975
    for i in range(5, 400, 10):
        far[i] = "changed"  # half of them
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 9), (2, " ".join(near), "en", "s", 9), (3, " ".join(far), "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_null_and_repeated_ids_go_only_with_near_duplicates(spark):
    # eleven texts of which no two are alike
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(11)]
    rows = [(None, ""), *((None, t) for t in texts[:6]), (None, texts[0]), (7, texts[6]), (7, texts[7]), (8, texts[7]), (9, texts[8]), (9, texts[9]), (10, texts[9]), (10, texts[8]), (11, texts[5]), (12, texts[10]), (12, texts[10])]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert Counter(t for _, t in kept) == Counter(["", *texts])
    assert Counter(kept) == Counter([(None, ""), *((None, t) for t in texts[:5]), (11, texts[5]), (7, texts[6]), (7, texts[7]), (9, texts[8]), (9, texts[9]), (12, texts[10])])
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(1, texts[0]), (5, texts[0]), (5, texts[1]), (6, texts[1])], "doc_id long, text string")).where("doc_id <> 5").collect()}
    assert component == {1: 1, 6: 5}


def test_empty_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.isEmpty(), name
        docs = out if out.columns == list(pipeline.COLUMNS) else docs


def test_run_leaves_one_table(spark, sf):
    from quarry.llm import common

    had = {path for _, path in common._WRITTEN}
    out = pipeline.run(spark, sf)
    assert out.count() > 0 and len({path for _, path in common._WRITTEN} - had) == 1


def test_queries_against_their_sql(spark, sf):
    """The queries that SQL can express, on the driver's smallest tables."""
    import duckdb

    from quarry.llm import queries

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, sf)
        result = con.execute(sql)
        have = [d[0] for d in result.description]
        assert sorted(have) == sorted(frame.columns), name
        assert Counter(tuple(r[c] for c in have) for r in frame.collect()) == Counter(result.fetchall()), name


def test_driver_contract():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
