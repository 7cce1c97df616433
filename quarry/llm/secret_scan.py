"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
any match must hold, for one of the query's alternatives, all its trigrams.
Texts give postings for just the trigrams that some query names; intersecting
postings leaves candidates, and only those are verified with the expression
itself.  A rule without mandatory trigrams has no query and scans every text.

Texts stay where they lie: candidates are numbers, and go to the texts as a
broadcast where a count shows them to be few enough, else both sides meet in a
shuffle in which only texts with a posting take part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # before 3.11
    import sre_constants as _c
    import sre_parse as _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Candidates (an id and a mask, 16 bytes) are broadcast up to this many.
BROADCAST_ROWS = 1_000_000
#: Matches of a text are added up in blocks of this many.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``group`` of a match must have ``least`` characters, or the match is dropped
    (after it has taken its place: matches are leftmost and do not overlap).
    ``scan`` may give an equal expression that is cheaper where every text is read.
    ``whole`` may give an expression that runs on from each match to the secret's
    end, where ``pattern`` only finds its beginning; both match at the same places.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    scan: str = ""
    whole: str = ""


_KEY_HEADER = "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
#: White space (also escaped) and what quotes or joins the lines of a key.
_KEY_GAP = "(?:\\s|\\\\++[nrt]|[>#*\"',|])*+"
#: A private key from its header to the END line, whatever stands between but another
#: BEGIN or END; without one, over the header's fields and the base64 lines that follow:
#: runs of 24 characters or more with a shorter one after them, and lines of nothing else.
#: Possessive, so that nothing recurses or is read twice.
_KEY_WHOLE = (
    _KEY_HEADER + "(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    f"|(?:{_KEY_GAP}(?:Proc-Type|DEK-Info|Comment): (?:[^\\r\\n\\\\-]|-(?!----))*+)*+"
    f"(?:{_KEY_GAP}[A-Za-z0-9+/=]{{24,}}+(?:[ \\t]++[A-Za-z0-9+/=]{{1,23}}+(?![A-Za-z0-9+/=]))?+"
    f"|[ \\t\"',]*+(?:[\\r\\n]|\\\\++[nr]){_KEY_GAP}[A-Za-z0-9+/=]++(?=[ \\t\"',]*+(?:[\\r\\n\\\\]|\\z)))*+)"
)

#: The base kinds, in their order.
BASE_RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True, "[0-9a-f]{24,}"),
)
#: Kinds beyond the base.
MORE_RULES = (
    Rule("private_key", _KEY_HEADER, whole=_KEY_WHOLE),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", "://[A-Za-z0-9._-]{1,64}:[^\\x00-\\x20:/@\"']{6,128}@"),
)
RULES = BASE_RULES + MORE_RULES


def _strings(nodes, most: int = 64):
    """Runs of exact strings a match must hold: a list of sets, one of each set's strings occurs."""
    runs, now = [], {""}

    def flush():
        nonlocal now
        runs.append(now)
        now = {""}

    for op, arg in nodes:
        if op is _c.LITERAL:
            parts = {chr(arg).lower()}
        elif op is _c.IN and all(x[0] is _c.LITERAL for x in arg) and len({chr(x[1]).lower() for x in arg}) <= 8:
            parts = {chr(x[1]).lower() for x in arg}
        elif op in (_c.SUBPATTERN, _c.BRANCH):
            branches = arg[1] if op is _c.BRANCH else [arg[3]]
            exact = [_strings(b) for b in branches]
            if op is _c.SUBPATTERN and not (len(exact[0]) == 1):
                flush()
                runs.extend(exact[0])
                continue
            if all(len(x) == 1 for x in exact):
                parts = set().union(*(x[0] for x in exact))
            else:  # alternatives of several runs: each gives its longest
                flush()
                runs.append(set().union(*(max(x, key=lambda s: min(map(len, s))) for x in exact)))
                continue
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[:2] == (0, 1) and len(x := _strings(arg[2])) == 1:
            parts = {"", *x[0]}
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1 and len(x := _strings(arg[2])) == 1 and arg[0] == arg[1] == 1:
            parts = x[0]
        elif op is _c.AT:
            continue
        else:
            flush()
            continue
        if len(now) * len(parts) > most:
            flush()
        now = {a + b for a in now for b in parts}
    flush()
    return [r for r in runs if r != {""}] if len(runs) > 1 else runs


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that must all occur; None: no trigram is mandatory."""
    best = None
    tree = list(_parser.parse(pattern))
    runs = _strings([*tree, (_c.ANY, None)])
    for run in runs:
        if run and min(map(len, run)) >= 3:
            found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            # an alternative that holds another's trigrams and more is implied by it
            found = sorted((x for x in found if not any(y < x for y in found)), key=sorted)
            if best is None or min(map(len, found)) > min(map(len, best)):
                best = found
    return best


def _held(trigrams: list[str], text: str) -> Column:
    return F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(F.lower(text), g))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for the named trigrams: ``trigram, doc_id``, a row for each text that holds it (case folded)."""
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(F.col("_l"), g))
    return docs.select("doc_id", F.lower("text").alias("_l")).select(F.explode(held).alias("trigram"), "doc_id")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, rules``: for each text in some intersection, the bits of the rules it may match."""
    queries = [(i, k, g) for i, r in enumerate(rules) for k, alternative in enumerate(trigram_query(r.pattern) or []) for g in sorted(alternative)]
    need = {}
    for i, k, _ in queries:
        need[i, k] = need.get((i, k), 0) + 1
    uses: dict[str, list] = {}
    for i, k, g in queries:
        uses.setdefault(g, []).append(F.struct(F.lit(1 << i).cast("long").alias("rule"), F.lit(k).alias("alt"), F.lit(need[i, k]).alias("need")))
    if not uses:
        return docs.select("doc_id", F.lit(0).cast("long").alias("rules")).limit(0)
    table = F.create_map(*[x for g, use in sorted(uses.items()) for x in (F.lit(g), F.array(*use))])
    return (
        postings(docs, sorted(uses))
        .distinct()
        .select("doc_id", F.explode(F.element_at(table, F.col("trigram"))).alias("u"))
        .groupBy("doc_id", "u.rule", "u.alt")
        .agg(F.count("*").alias("n"), F.max("u.need").alias("need"))
        .where("n = need")
        .groupBy("doc_id")
        .agg(F.bit_or("rule").alias("rules"))
    )


def _spans(rule: Rule, order: int, pattern: str) -> Column:
    """The rule's spans in ``_t`` by ``pattern``: array of (start, place in the rules, end), in code points.

    The pieces between matches and the matches themselves alternate, so their
    lengths add up to positions: within blocks first, then over blocks, as an
    array that grows by one costs its length each time.
    """
    pattern = pattern.replace("\\", "\\\\").replace("'", "\\'")
    plain = "cast(array() as array<int>)" if not rule.group else f"transform(regexp_extract_all(_t, '{pattern}', {rule.group}), x -> length(x))"
    whole = f"transform(regexp_extract_all(_t, '{pattern}', 0), x -> length(x))"
    gaps = f"transform(split(_t, '{pattern}', -1), x -> length(x))"
    kept = "x.`1`" if not rule.group else "x.`2`"
    spans = "array<struct<start:int,kind:int,end:int,kept:int>>"
    block = (
        f"aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}), named_struct('at', 0, 'out', cast(array() as {spans})), "
        f"(a, x) -> if(x.`1` is null, a, named_struct('at', a.at + x.`0` + x.`1`, 'out', concat(a.out, array(named_struct('start', a.at + x.`0`, 'kind', {order}, 'end', a.at + x.`0` + x.`1`, 'kept', {kept}))))))"
    )
    blocks = f"transform(array(arrays_zip({gaps}, {whole}, {plain})), z -> transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> {block}))[0]"
    # each block with the ends of those before it
    placed = (
        f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<struct<at:int,out:{spans}>>)), "
        "(a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(named_struct('at', a.at, 'out', x.out)))), a -> a.out)"
    )
    moved = "named_struct('start', y.start + x.at, 'kind', y.kind, 'end', y.end + x.at, 'kept', y.kept)"
    return F.expr(f"filter(flatten(transform({placed}, x -> transform(x.out, y -> {moved}))), x -> x.kept >= {rule.least})")


def _listed(spans: str, kinds: str) -> str:
    return f"array_join(transform({spans}, x -> concat({kinds}[x.kind], ':', x.start, ':', x.end)), ',')"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = (), few: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, ``secrets`` (array of start, kind, end by start then kind) and the columns in ``keep``; a row for each row.

    ``secrets`` reach to each secret's end; :func:`digest` lists the matches of
    the rules' patterns, as its SQL does.

    Null and empty texts have no secret.  A null ``doc_id`` has no posting to
    look up, so its text is verified against all rules.  Rows that repeat an id
    share their candidates, which verification then decides text by text.
    ``few`` is the number of candidates up to which they are broadcast.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"), *keep)
    found = candidates(source.select("doc_id", F.col("_t").alias("text")).where("doc_id is not null"), rules)
    indexed = sum(1 << i for i, r in enumerate(rules) if trigram_query(r.pattern))
    found = materialize(found, "candidates")
    if found.count() <= few:
        rows = source.join(F.broadcast(found), "doc_id", "left")
    else:
        trigrams = sorted({g for r in rules for alternative in trigram_query(r.pattern) or [] for g in alternative})
        any_ = F.size(_held(trigrams, "_t")) > 0
        joined = source.where(any_ & F.col("doc_id").isNotNull()).join(found.hint("shuffle_hash"), "doc_id", "left")
        rows = joined.unionByName(source.where(~any_ | F.col("doc_id").isNull()).withColumn("rules", F.lit(None).cast("long")))
    rows = rows.withColumn("_r", F.expr(f"if(doc_id is null, {indexed}L, coalesce(rules, 0L))")).drop("rules")
    empty = "cast(array() as array<struct<start:int,kind:int,end:int,kept:int>>)"
    parts = []
    for i, r in enumerate(rules):
        gate = F.col("_r").bitwiseAND(F.lit(1 << i)) != 0 if indexed >> i & 1 else F.lit(True)
        parts.append(F.when(gate & F.col("_t").rlike(r.scan or r.pattern), _spans(r, i, r.scan or r.pattern)).otherwise(F.expr(empty)))
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    rows = rows.withColumn("_s", F.array_sort(F.concat(*parts)))
    whole = [F.when(F.expr(f"exists(_s, x -> x.kind = {i})"), _spans(r, i, r.whole)).otherwise(F.expr(empty)) for i, r in enumerate(rules) if r.whole]
    short = ", ".join(["-1", *(str(i) for i, r in enumerate(rules) if r.whole)])
    rows = rows.withColumn("_e", F.array_sort(F.concat(F.expr(f"filter(_s, x -> x.kind not in ({short}))"), *whole)) if whole else F.col("_s"))
    return rows.select(
        "doc_id", *keep, F.expr(f"transform(_e, x -> named_struct('start', cast(x.start as long), 'kind', {kinds}[x.kind], 'end', cast(x.end as long)))").alias("secrets"), F.col("_s"), F.col("_t").alias("text")
    )


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds and the joined spans of :func:`scan`'s rows."""
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    count = lambda k: F.expr(f"cast(size(filter(_s, x -> x.kind = {k})) as long)")
    base = [i for i, r in enumerate(rules) if r.base]
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(F.expr(_listed(f"filter(_s, x -> x.kind <= {max(base)})", kinds)), 256).alias("base_sha256"),
        F.expr(_listed("_s", kinds)).alias("spans"),
    )


def redact(scanned: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """:func:`scan`'s rows with every secret in ``text`` replaced by ``mask``; spans that overlap are masked as one.

    Texts with many secrets are cut in blocks of spans first, then span by span
    within the block's own text, so that no long text is gone through from its
    start for each span.
    """
    gaps = "array<struct<a:bigint,b:bigint>>"  # what stays, before each mask
    inner = (
        f"aggregate(slice(secrets, n * {BLOCK} + 1, {BLOCK}), named_struct('at', o.at, 'gaps', cast(array() as {gaps})), "
        "(i, x) -> named_struct('at', greatest(i.at, x.end), 'gaps', if(x.start >= i.at, concat(i.gaps, array(named_struct('a', i.at, 'b', x.start))), i.gaps)))"
    )
    outer = (
        f"aggregate(sequence(0, (size(secrets) - 1) div {BLOCK}), named_struct('at', 0L, 'out', cast(array() as array<{gaps}>)), "
        f"(o, n) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(o.out, array(r.gaps))))[0])"
    )
    part = lambda text, a, n: f"substring({text}, cast({a} + 1 as int), cast({n} as int))"
    block = f"transform(array({part('text', 'g[0].a', 'element_at(g, -1).b - g[0].a')}), t -> array_join(transform(g, y -> {part('t', 'y.a - g[0].a', 'y.b - y.a')}), '{mask}'))[0]"
    whole = f"transform(array({outer}), o -> concat(array_join(transform(filter(o.out, g -> size(g) > 0), g -> {block}), '{mask}'), '{mask}', substring(text, cast(o.at + 1 as int), length(text))))[0]"
    return scanned.withColumn("text", F.expr(f"if(size(secrets) = 0, text, {whole})"))
