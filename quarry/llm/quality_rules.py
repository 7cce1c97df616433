"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements
and one long of failure bits, and is stored.  Policies (name, version, mask of
rules) are then bit tests on the stored table, and ablations are bitwise
aggregates over it: no policy change reads a text again.

All of it is DataFrame functions.  A document is measured within its row, so
nothing is shuffled and a hot source costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words are runs of anything but ASCII white space.
SPACE = "[ \\t-\\r]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``fails`` (SQL over the measurements) holds."""

    name: str
    fails: str


#: Bit i of the ledger belongs to rule i; append only, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "10 * n_upper > 3 * n_letters"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("stutter", "4 * n_stutter > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(r.name for r in RULES))


def _matches(pattern: str) -> Column:
    return F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (a bit for each rule failed).

    A null or empty text measures zero everywhere and fails ``few_words`` only.
    Repeated rows and null ids give a row each; an empty table gives none.
    Windows are compared by 64-bit hashes within one document.
    """
    spans = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    measured = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
        .withColumn("_w", F.array_remove(F.split("_t", SPACE + "+"), ""))
        .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
        .select(
            "doc_id",
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.regexp_replace("_t", SPACE + "+", "")).cast("long").alias("word_chars"),
            _matches("[#*$%&|<>]").cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            _matches("\\p{Lu}+").cast("long").alias("n_upper"),
            _matches("\\p{L}+").cast("long").alias("n_letters"),
            F.expr("cast(size(filter(_w, (w, i) -> coalesce(w = get(_w, i - 1), false))) as long)").alias("n_stutter"),
            F.expr(f"if(size(_w) > {WINDOW}, transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({spans})), array())").alias("_h"),
        )
        # only texts with a repeated window pay for the sort that finds where
        .withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> named_struct('h', h, 'p', i))), array())"))
        .drop("_h")
        .withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, i) -> coalesce(get(_s, i - 1).h = x.h, false) or coalesce(get(_s, i + 1).h = x.h, false)), x -> x.p))"))
        .withColumn("n_repeat_words", F.expr(f"aggregate(_p, named_struct('n', 0L, 'last', -{WINDOW}), (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p), a -> a.n)"))
        .drop("_s", "_p")
    )
    bits = " | ".join(f"if({r.fails}, {1 << i}L, 0L)" for i, r in enumerate(RULES))
    return measured.withColumn("failed", F.expr(bits))


def stored(ledger: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder; policies and ablations read it instead of the texts."""
    return materialize(ledger, "ledger")


def apply_policy(ledger: DataFrame, policy: Policy = DEFAULT, column: str = "kept") -> DataFrame:
    """Add the policy's verdict: true where none of its rules failed."""
    return ledger.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(ledger: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """What each rule of a policy does: ``rule, n_failed, n_only, n_kept, n_kept_without``.

    ``n_only`` counts documents that this rule alone rejects.  Rows are first
    counted by their bits (at most two to the number of rules of them), so the
    rest works on a table of bounded size.
    """
    bits = ledger.select(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in policy.rules])).alias("r")
    return (
        bits.select("bits", "n", rules)
        .groupBy("r.rule")
        .agg(
            F.sum(F.expr("if(bits & r.bit <> 0, n, 0L)")).alias("n_failed"),
            F.sum(F.expr("if(bits = r.bit, n, 0L)")).alias("n_only"),
            F.sum(F.expr("if(bits = 0, n, 0L)")).alias("n_kept"),
            F.sum(F.expr("if(bits & ~r.bit = 0, n, 0L)")).alias("n_kept_without"),
        )
    )
