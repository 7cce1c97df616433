"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the mixture over its
natural share of the corpus.  A document's number of copies is the Poisson
quantile, with that rate as mean, of a uniform number hashed from its id and a
seed: the same document gets the same count on every run and machine, rates
hold in expectation for whole and part, and no pass over counts is needed.
Documents are exploded by their counts and shuffled globally on a hash of
(seed, id, copy).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: A uniform number has this many bits; beyond the quantile of its largest value no count occurs.
BITS = 52


def rates(docs: DataFrame, weights: dict[str, float], key: str = "source", size: Column | None = None, total: float | None = None) -> tuple[dict[str, float], float]:
    """Repetition rate of each named source, and of all others together.

    ``size`` is what weights share out (default: characters of the text);
    ``total`` is the mixture's size, by default the corpus's.  What the named
    weights leave of 1 goes to the other sources as they are.  Only sums for
    named sources and one for the rest reach the driver.
    """
    size = F.length("text") if size is None else size
    named = F.when(F.col(key).isin(list(weights)), F.col(key))
    mass = {r[0]: float(r[1] or 0) for r in docs.groupBy(named.alias("k")).agg(F.sum(size)).collect()}
    whole = sum(mass.values())
    total = whole if total is None else total
    rest = max(0.0, 1.0 - sum(weights.values()))
    return {k: w * total / mass[k] for k, w in weights.items() if mass.get(k)}, rest * total / mass[None] if mass.get(None) else 0.0


def cumulative(rate: float) -> list[float]:
    """The Poisson distribution function from 0 up, until the greatest uniform number is below it."""
    if rate <= 0:
        return []
    found, log_p, total, k = [], -rate, 0.0, 0
    while total < 1 - 2.0**-BITS:
        total += math.exp(log_p)
        if found and k > rate and total <= found[-1]:
            break
        found.append(total)
        k += 1
        log_p += math.log(rate / k)
    return found


def _hashed(*parts: Column) -> Column:
    """``BITS`` bits of a hash of the parts as text (null: empty); MD5, so that any engine can repeat it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def copies(rate: dict[str, float], other: float, key: str, seed: int, ident: str = "doc_id") -> Column:
    """The number of copies of a row: its source's Poisson quantile of its hashed uniform number."""
    uniform = _hashed(F.lit(seed), F.col(ident)) / F.lit(float(1 << BITS))

    def quantile(mean: float) -> Column:
        steps = cumulative(mean)
        if not steps:
            return F.lit(0)
        table = F.array(*map(F.lit, steps))
        return F.size(F.filter(table, lambda c: c <= uniform))

    chosen = F.lit(None).cast("int")
    for name, mean in rate.items():
        chosen = F.when(F.col(key) == name, quantile(mean)).otherwise(chosen)
    return F.coalesce(chosen, quantile(other))


def mix(docs: DataFrame, weights: dict[str, float], seed: int = 17, key: str = "source", ident: str = "doc_id", total: float | None = None, size: Column | None = None) -> DataFrame:
    """The mixture: the input's columns and ``mix_copy`` (from 1), ``mix_copies``, ``mix_key``; globally shuffled.

    ``mix_key`` is the row's place in the shuffled order (a hash of ``BITS`` bits); every
    partition holds a range of an unrelated hash and is sorted by it.  Nulls: a
    null source counts as other, a null or empty text weighs nothing but is
    replicated like the rest of its source, null ids share one uniform number.
    Repeated rows are replicated each.  A named source without any character
    cannot be given a share and is treated as other.  An empty table gives no row.
    Input columns named as the three added ones are replaced by them.
    """
    rate, other = rates(docs, weights, key, size, total)
    return (
        docs.withColumn("mix_copies", copies(rate, other, key, seed, ident))
        .withColumn("mix_copy", F.explode(F.expr("if(mix_copies > 0, sequence(1, mix_copies), array())")))
        .withColumn("mix_key", _hashed(F.lit(seed), F.col(ident), F.col("mix_copy")))
        .repartition(partitions(docs.sparkSession), "mix_key")
        .sortWithinPartitions("mix_key")
    )
