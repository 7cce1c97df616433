"""The named queries over the current view, as functions of a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import country, lookup_name
from ..functions.text import filled, slug, values
from ..schema import DETAIL_COLUMNS, LIST_COLUMNS
from .predicates import explorer_filter, holds, page, stale

PLATFORM = "Shopify"
BRIEF = ["domain", "http_title", "http_tech", "tranco_rank", "inferred_country"]


def ranked(rows: DataFrame, n: int | None) -> DataFrame:
    """By popularity, unranked last, names settling ties."""
    ordered = rows.orderBy(F.asc_nulls_last("tranco_rank"), "domain")
    return ordered if n is None else ordered.limit(n)


def with_country(rows: DataFrame) -> DataFrame:
    """The query-time country in place of the stored one."""
    return rows.withColumn("_c", country()).drop("inferred_country").withColumnRenamed("_c", "inferred_country")


def using(rows: DataFrame, tech: str, fold: bool = False) -> DataFrame:
    return rows.where(holds("http_tech", tech, fold))


def store_count(rows: DataFrame, tech: str = PLATFORM, fold: bool = False) -> DataFrame:
    return using(rows, tech, fold).agg(F.count("*").alias("cnt"))


def sample_stores(rows: DataFrame, tech: str = PLATFORM, n: int = 6, columns: list[str] = BRIEF, fold: bool = False) -> DataFrame:
    """Titled stores with a technology, most popular first."""
    return ranked(using(rows, tech, fold).where(filled("http_title") != ""), n).select(*columns)


def recent_stores(rows: DataFrame, tech: str = PLATFORM, n: int = 20, columns: list[str] = BRIEF) -> DataFrame:
    return using(rows, tech).where(filled("http_title") != "").orderBy(F.desc("enriched_at"), "domain").limit(n).select("enriched_at", *columns)


def tech_stats(rows: DataFrame, tech: str) -> DataFrame:
    return using(rows, tech).agg(
        F.count("*").alias("total"), F.avg("http_response_time").alias("avg_response"), F.count_if(F.col("http_status") == 200).alias("ok"), F.count_if(F.col("tranco_rank").isNotNull() & (F.col("tranco_rank") <= 100_000)).alias("top_100k")
    )


def distribution(rows: DataFrame, tech: str | None, column: str | Column, n: int | None = 10, name: str = "value") -> DataFrame:
    """Rows by a non-empty column, most first."""
    rows = rows if tech is None else using(rows, tech)
    value = F.col(column) if isinstance(column, str) else column
    counted = rows.select(value.alias(name)).where(filled(name) != "").groupBy(name).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), name)
    return counted if n is None else counted.limit(n)


def directory(rows: DataFrame, column: str = "http_tech", least: int = 5, n: int = 500, without: str | None = None) -> DataFrame:
    """Values of a pipe-joined column with their counts."""
    counted = rows.select(F.explode(values(column)).alias("tech")).groupBy("tech").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    return (counted if without is None else counted.where(F.col("tech") != without)).orderBy(F.desc("cnt"), "tech").limit(n)


def co_occurring(rows: DataFrame, tech: str, n: int = 20) -> DataFrame:
    return directory(using(rows, tech), "http_tech", 2, n, tech)


def compare(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Stores with either technology and with both, in one pass."""
    return rows.select(holds("http_tech", a).alias("a"), holds("http_tech", b).alias("b")).agg(F.count_if("a").alias("count_a"), F.count_if("b").alias("count_b"), F.count_if(F.col("a") & F.col("b")).alias("count_both"))


def compare_countries(rows: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """Top countries of both technologies, one scan."""
    side = F.explode(F.array_compact(F.array(F.when(holds("http_tech", a), F.lit(a)), F.when(holds("http_tech", b), F.lit(b))))).alias("tech")
    counted = rows.select(side, country().alias("value")).groupBy("tech", "value").agg(F.count("*").alias("cnt"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("tech").orderBy(F.desc("cnt"), "value"))).where(F.col("place") <= n)


def top_stores(rows: DataFrame, tech: str | None = None, code: str | None = None, n: int = 50, platform: str | None = PLATFORM) -> DataFrame:
    """Most popular stores of a platform, with a technology, in a country."""
    if platform:
        rows = using(rows, platform)
    if tech:
        rows = using(rows, tech)
    rows = with_country(rows)
    if code:
        rows = rows.where(F.col("inferred_country") == code)
    return ranked(rows, n).select("domain", "http_title", "tranco_rank", "inferred_country")


def rate(log: DataFrame, as_of: Column, seconds: int, tech: str | None = None, at: str = "enriched_at") -> DataFrame:
    """Rows of the last ``seconds`` and their rate a second, rounded to one place."""
    rows = log.where((F.col(at) > as_of - F.expr(f"INTERVAL {int(seconds)} SECONDS")) & (F.col(at) <= as_of))
    rows = rows if tech is None else using(rows, tech)
    return rows.agg(F.count("*").alias("cnt")).withColumn("per_second", F.floor(F.col("cnt") / F.lit(float(seconds)) * 10 + 0.5) / 10)


def stale_domains(rows: DataFrame, as_of: Column, weekly: int = 7, monthly: int = 30, n: int = 5000) -> DataFrame:
    return ranked(rows.where(stale(as_of, weekly, monthly)), n).select("domain")


def explore(rows: DataFrame, filters: dict[str, str], number: int = 1, size: int = 25, as_of: Column | None = None, platform: str = PLATFORM) -> DataFrame:
    rows = with_country(rows)
    return page(ranked(rows.where(explorer_filter(filters, F.col("inferred_country"), as_of, platform)), None), number, size).select(*[c for c in LIST_COLUMNS if c in rows.columns], "inferred_country")


def explore_count(rows: DataFrame, filters: dict[str, str], as_of: Column | None = None, platform: str = PLATFORM) -> DataFrame:
    return with_country(rows).where(explorer_filter(filters, F.col("inferred_country"), as_of, platform)).agg(F.count("*").alias("cnt"))


def detail(rows: DataFrame, domain: str, columns: tuple[str, ...] = DETAIL_COLUMNS) -> DataFrame:
    return rows.where(F.col("domain") == domain).select(*[c for c in columns if c in rows.columns]).limit(1)


def export(rows: DataFrame, filters: dict[str, str], n: int, as_of: Column | None = None, platform: str = PLATFORM, columns: tuple[str, ...] = DETAIL_COLUMNS) -> DataFrame:
    rows = with_country(rows)
    return ranked(rows.where(explorer_filter(filters, F.col("inferred_country"), as_of, platform)), n).select(*[c for c in columns if c in rows.columns])


def distinct_values(rows: DataFrame, column: str | Column, needle: str = "", n: int = 50) -> DataFrame:
    """Typeahead: distinct non-empty values that hold a text, whatever its case."""
    found = rows.select((F.col(column) if isinstance(column, str) else column).alias("value")).where((filled("value") != "") & F.contains(F.lower("value"), F.lit(needle.lower())))
    return found.distinct().orderBy("value").limit(n)


def distinct_parts(rows: DataFrame, column: str = "http_tech", needle: str = "", n: int = 50, tech: str | None = None) -> DataFrame:
    """The same over the values of a pipe-joined column."""
    rows = rows if tech is None else using(rows, tech)
    return rows.select(F.explode(values(column)).alias("value")).where(F.contains(F.lower("value"), F.lit(needle.lower()))).distinct().orderBy("value").limit(n)


def suggest(rows: DataFrame, needle: str, n: int = 10) -> DataFrame:
    """Technologies that hold a text: those that begin with it first, then the most used."""
    low = F.lower("tech")
    return directory(rows).where(F.contains(low, F.lit(needle.lower()))).orderBy(F.desc(F.startswith(low, F.lit(needle.lower()))), F.desc("cnt"), "tech").limit(n)


def landing(rows: DataFrame, tech: str = PLATFORM, exact: bool = True) -> DataFrame:
    """Totals of the landing page in one scan: stores, rows, distinct technologies and apps."""
    mark = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    one = F.array(F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    marks = F.concat(mark("total", one), mark("stores", F.when(holds("http_tech", tech), one).otherwise(none)), mark("n_tech", values("http_tech")), mark("n_apps", values("http_apps")))
    found = rows.select(F.explode(marks).alias("m")).select("m.*")
    of = lambda kind: F.col("kind") == kind
    if exact:
        counted = found.groupBy("kind", "x").agg(F.count("*").alias("n"))
        return counted.agg(*[F.coalesce(F.sum(F.when(of(k), F.col("n"))), F.lit(0)).alias(k) for k in ("stores", "total")], *[F.count_if(of(k)).alias(k) for k in ("n_tech", "n_apps")])
    return found.agg(*[F.count_if(of(k)).alias(k) for k in ("stores", "total")], *[F.approx_count_distinct(F.when(of(k), F.col("x"))).alias(k) for k in ("n_tech", "n_apps")])


def _block(name: str, rows: DataFrame, label: str, number: str | None = "cnt") -> DataFrame:
    """Rows of an answer of several blocks: ``block, label, number``."""
    return rows.select(F.lit(name).alias("block"), F.col(label).cast("string").alias("label"), (F.col(number) if number else F.lit(None)).cast("double").alias("number"))


def tech_page(rows: DataFrame, slug_text: str, n: int = 100) -> DataFrame:
    """A technology's page: ``block, label, number`` of stores, five distributions, what it occurs with, and its figures.

    Stores are those with the exact name (the slug's words in capitals), or, if
    there is none, with the slug's words in any case; all else goes by the name.
    """
    words = [w for w in slug_text.split("-")]
    name = " ".join(w[:1].upper() + w[1:].lower() for w in words)
    stores = sample_stores(rows, name, n, ["domain", "tranco_rank"])
    if stores.isEmpty():
        stores = sample_stores(rows, " ".join(words), n, ["domain", "tranco_rank"], True)
    mine = using(rows, name)
    figures = tech_stats(rows, name)
    measures = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("number")) for c in figures.columns])).alias("m")
    blocks = [
        _block("stores", stores, "domain", "tranco_rank"),
        _block("countries", distribution(mine, None, country()), "value"),
        _block("languages", distribution(mine, None, "http_language"), "value"),
        _block("hosting", distribution(mine, None, "bgp_asn_org"), "value"),
        _block("registrars", distribution(mine, None, "rdap_registrar"), "value"),
        _block("together", co_occurring(rows, name), "tech"),
        _block("figures", figures.select(measures).select("m.*"), "label", "number"),
    ]
    return reduce(DataFrame.unionByName, blocks)


def landing_page(rows: DataFrame, log: DataFrame, as_of: Column, tech: str = PLATFORM, exact: bool = True) -> DataFrame:
    """The landing page: ``block, label, number`` of totals, rates, the newest stores and the most popular ones."""
    wide_row = landing(rows, tech, exact)
    totals = wide_row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("cnt")) for c in wide_row.columns])).alias("m")).select("m.*")
    rates = reduce(DataFrame.unionByName, [rate(log, as_of, seconds).select(F.lit(label).alias("label"), "cnt") for label, seconds in (("last_minute", 60), ("last_hour", 3600))])
    return reduce(
        DataFrame.unionByName,
        [_block("totals", totals, "label"), _block("rates", rates, "label"), _block("recent", recent_stores(rows, tech, 20), "domain", "tranco_rank"), _block("top", sample_stores(rows, tech, 10), "domain", "tranco_rank")],
    )


def lookup(asked: DataFrame, current: DataFrame, as_of: Column, name: str = "asked", days: int = 7) -> DataFrame:
    """What is typed, met with the current view: ``asked, domain, answer, http_title, http_tech``.

    ``answer`` is ``stored`` where the row is younger than ``days`` (whole days
    between dates), else ``enrich``: the pipeline has to run.
    """
    rows = asked.select(F.col(name).alias("asked"), lookup_name(name).alias("domain"))
    found = rows.join(current.select("domain", "enriched_at", "http_title", "http_tech"), "domain", "left")
    fresh = F.coalesce(F.datediff(as_of, F.to_date("enriched_at")) < days, F.lit(False))
    return found.select("asked", "domain", F.when(fresh, "stored").otherwise("enrich").alias("answer"), *[F.when(fresh, F.col(c)).alias(c) for c in ("http_title", "http_tech")])


def newest(rows: DataFrame, n: int, at: str, tie: str) -> DataFrame:
    """The last ``n`` rows: a list of errors or samples that is kept short."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def sitemap(rows: DataFrame, tech: str = PLATFORM, n: int = 10_000, base: str = "https://example.com", fixed: tuple[str, ...] = ("/", "/top", "/tech", "/compare"), least: int = 5, most: int = 500) -> DataFrame:
    """Locations: stores, two for each technology, one for each country, and fixed ones.

    Technologies and countries are counted in one scan, as values of two kinds.
    """
    spark = rows.sparkSession
    stores = ranked(using(rows, tech), n).select(F.concat(F.lit(base + "/store/"), F.regexp_replace("domain", "\\.", "-")).alias("loc"))
    mark = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    none = F.expr("cast(array() as array<string>)")
    marks = F.concat(mark("tech", values("http_tech")), mark("country", F.when(holds("http_tech", tech), F.array(country())).otherwise(none)))
    counted = rows.select(F.explode(marks).alias("m")).select("m.*").groupBy("kind", "x").agg(F.count("*").alias("cnt"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cnt"), "x")))  # distinct values, not rows
    listed = placed.where((F.col("kind") == "country") | ((F.col("cnt") >= least) & (F.col("place") <= most)))
    of_tech = F.array(F.concat(F.lit(base + "/tech/"), slug("x")), F.concat(F.lit(base + "/top/stores-using-"), slug("x")))
    of_country = F.array(F.concat(F.lit(base + "/top/stores-"), F.lower("x")))
    pages = listed.select(F.explode(F.when(F.col("kind") == "tech", of_tech).otherwise(of_country)).alias("loc"))
    return stores.unionByName(pages).unionByName(spark.createDataFrame([(base + x,) for x in fixed], "loc string"))
