"""The corpus pipeline: raw documents to packed training sequences.

Every stage calls one operator of ``quarry.llm``, reads what the stage before
it wrote, and (but for the last) returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality_classifier, secret_scan, simhash
from quarry.llm.common import let_go, materialize, passing
from quarry.llm.queries import MIX_WEIGHTS, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
#: Near duplicates: words in a shingle, and fingerprints of each text.
SHINGLE, PRINTS = 5, 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; labels of held-out rows are not learnt from.

    A null text scores as an empty one; repeated rows are judged alike, null ids as any other.
    """
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs.select(*COLUMNS), model, COLUMNS)
    return scored.where(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one of the least id, known ids before null.

    Fingerprints are of five-word shingles, ``PRINTS`` for each text.  Rows are
    told apart by id and text, so rows with a null or a repeated id go only where
    their texts are near duplicates.
    """
    keyed = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    prints = materialize(simhash.fingerprints(keyed, SHINGLE, ("text_key",), PRINTS), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "n")).alias("k")
    first = prints.groupBy(F.xxhash64("fps").alias("node"), "doc_id", "text_key").agg(F.count("*").alias("n")).groupBy("node").agg(least)
    found = first.join(simhash.linked(prints), "node").groupBy("component").agg(F.min("k").alias("k"))
    kept = materialize(found.select("k.doc_id", "k.text_key", "k.n"), "kept")
    let_go(spark)
    same = keyed["doc_id"].eqNullSafe(kept["doc_id"]) & (keyed["text_key"] == kept["text_key"])
    out = keyed.join(kept.hint("shuffle_hash"), same, "left_semi")
    # several rows of one id and text
    out = out if kept.where("n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text_key"])
    return out.select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, a row for a row, with every secret's span masked; a null text becomes empty."""
    masked = secret_scan.redact(secret_scan.scan(docs, keep=("lang", "source", "n_chars")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, globally shuffled; a null source counts with the rest."""
    return mixing.mix(docs.select(*COLUMNS), MIX_WEIGHTS).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences; a null or empty text is its end token."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("mixing to weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote on its way goes with it, its input once the next table is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing():
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), over=before)
        before = docs
        let_go(spark)
    return docs
