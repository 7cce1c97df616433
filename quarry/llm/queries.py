"""The queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_graph, html_extract, license_scan, mixing, packing, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.apply_policy(quality_rules.stored(quality_rules.ledger(_table(spark, sf_dir, "documents"))))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(quality_rules.BASE.mask)) != 0).alias("base_failed"), "kept", F.col("failed").alias("failed_bits")
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy does, from the stored ledger."""
    return quality_rules.ablations(quality_rules.stored(quality_rules.ledger(_table(spark, sf_dir, "documents"))))


def op2_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann_graph.search(ann_graph.build(vectors), vectors.where("vec_id % 50 = 0"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), texts=False)


def tokenizer() -> str:
    """Where the public vocabulary file of the packing query lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the license scan, which SQL can express."""
    return license_scan.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Target shares of the mixture, by characters; the other sources keep what is left.
MIX_WEIGHTS = {"src0": 0.10, "src1": 0.10, "src2": 0.08, "src3": 0.03}


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, MIX_WEIGHTS)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return numbered | {"quality_ablations": quality_ablations, "license_phrases": license_phrases}


#: Values of the rules as in quality_rules; windows are compared as text here.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
u AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= 8),
v AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS win FROM u),
r AS (SELECT doc_id, p FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::BIGINT AS n_upper,
             (length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')))::BIGINT AS n_letters,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutter, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
              + CASE WHEN 10 * n_upper > 3 * n_letters THEN 16 ELSE 0 END
              + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END
              + CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END + CASE WHEN 4 * n_stutter > n_words THEN 128 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

#: The ledger's bits, rule by rule.
ABLATIONS_SQL = (
    "WITH b AS ({0}), r(rule, bit) AS (VALUES " + ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(quality_rules.RULES)) + ") "
    "SELECT rule, count(*) FILTER (failed_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failed_bits = bit)::BIGINT AS n_only, count(*) FILTER (failed_bits = 0)::BIGINT AS n_kept, count(*) FILTER (failed_bits & ~bit = 0)::BIGINT AS n_kept_without FROM b, r GROUP BY rule"
).format(OP1_SQL)

#: Places of the phrases' words among the words of the lower-cased text.
PHRASES_SQL = (
    r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents), "
    "p(phrase, label) AS (VALUES " + ", ".join(f"({p.split()}, '{label}')" for p, label in license_scan.BASE_PHRASES.items()) + "), "
    "f AS (SELECT doc_id, label, unnest(list_filter(range(0, len(ws) - len(phrase) + 1), lambda i: ws[i + 1:i + len(phrase)] = phrase)) AS i FROM w, p WHERE len(ws) >= len(phrase)), "
    "a AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id) "
    "SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN a USING (doc_id)"
)

#: The article's blocks by its tags, as all pages of the driver name it; character references as they occur there.
OP10_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h1|h2|h3|div|ul|ol|li|blockquote)>'), lambda x: trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

#: Every 100-byte string's first start, the later ones' union, and what is left.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS s FROM d)),
r AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, s) > 1),
i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS n FROM r),
g AS (SELECT doc_id, s, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM i),
x AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, b AS lo, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS hi FROM x UNION ALL SELECT doc_id, 0, min(a) FROM x GROUP BY doc_id),
c AS (SELECT p.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, length(h) // 2) - lo)), '' ORDER BY lo) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def secret_spans_sql() -> str:
    """Spans from the pieces between matches, as in secret_scan, for every rule."""
    kinds = []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = (rule.scan or rule.pattern).replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(m[i]) AS n, length(v[i]) AS p "
            f"FROM (SELECT doc_id, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM d)) WHERE p >= {rule.least}"
        )
    base = max(i for i, r in enumerate(secret_scan.RULES) if r.base)
    joined = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o)"
    counts = ", ".join(f"count(*) FILTER (o = {i})::BIGINT AS n_{r.kind}" for i, r in enumerate(secret_scan.RULES) if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(kinds)}), "
        f"a AS (SELECT doc_id, {counts}, {joined} FILTER (o <= {base}) AS base, {joined} AS spans FROM s GROUP BY doc_id) "
        f"SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"
    )


OP9_SQL = """
WITH w(source, weight) AS (VALUES {weights}),
s AS (SELECT w.source, sum(length(text))::DOUBLE AS mass FROM documents LEFT JOIN w USING (source) GROUP BY w.source),
t AS (SELECT sum(mass) AS total FROM s),
r AS (SELECT s.source, CASE WHEN s.source IS NULL THEN {rest} ELSE weight END * total / mass AS rate FROM s LEFT JOIN w USING (source), t),
k AS (SELECT unnest(range(0, 200)) AS k),
f AS (SELECT r.source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM r, k) AS r GROUP BY r.source),
u AS (SELECT d.*, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u, w.source AS named FROM documents d LEFT JOIN w USING (source)),
n AS (SELECT u.*, len(list_filter(cdf, lambda c: c <= u))::INTEGER AS mix_copies FROM u JOIN f ON u.named IS NOT DISTINCT FROM f.source)
SELECT doc_id, text, lang, source, n_chars, mix_copies, mix_copy::INTEGER AS mix_copy,
       ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || mix_copy), 1, 13))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(1, mix_copies + 1)) AS mix_copy FROM n)
"""


def oracle_sql() -> dict[str, str]:
    weights = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in MIX_WEIGHTS.items())
    return {"op1_quality_rules": OP1_SQL, "quality_ablations": ABLATIONS_SQL, "license_phrases": PHRASES_SQL, "op10_html_extract": OP10_SQL, "op3_suffix_dedup": OP3_SQL, "op7_secret_scan": secret_spans_sql(), "op9_poisson_mixing": OP9_SQL.format(weights=weights, rest=max(0.0, 1.0 - sum(MIX_WEIGHTS.values())))}
