"""Filters of the explorer: a dictionary compiled to one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled

#: Freshness choices and their intervals.
FRESHNESS = {"24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}
#: Business models that are crawled weekly.
DIGITAL_MODELS = ["Ecommerce", "SaaS", "Tool", "Marketplace", "Agency"]


def holds(column: str, needle: str, fold: bool = False) -> Column:
    """A literal substring; ``fold`` ignores case."""
    text = filled(column)
    return F.contains(F.lower(text), F.lit(needle.lower())) if fold else F.contains(text, F.lit(needle))


def listed(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def one_of(column: Column, value: str | None) -> Column | None:
    wanted = listed(value)
    return None if not wanted else column == wanted[0] if len(wanted) == 1 else column.isin(wanted)


def explorer_filter(filters: dict[str, str], country: Column, as_of: Column | None = None, platform: str = "Shopify") -> Column:
    """All filters must hold; unknown names and empty values are ignored.

    ``tech`` and ``shopify_app`` take several substrings that must all occur;
    the business model ``Shopify`` stands for the platform's technology.
    """
    found: list[Column | None] = []
    for name, value in filters.items():
        if name in ("tech", "shopify_app"):
            found += [holds("http_tech" if name == "tech" else "http_apps", x, True) for x in listed(value)]
        elif name == "country":
            found.append(one_of(country, value))
        elif name in ("industry", "revenue", "employees", "language"):
            found.append(one_of(F.col({"industry": "industry", "revenue": "estimated_revenue", "employees": "estimated_employees", "language": "http_language"}[name]), value))
        elif name == "business_model" and listed(value):
            models = [x for x in listed(value) if x != platform]
            parts = ([F.col("business_model").isin(models)] if models else []) + ([holds("http_tech", platform, True)] if platform in listed(value) else [])
            found.append(reduce(lambda a, b: a | b, parts))
        elif name == "domain" and value:
            found.append(holds("domain", value.lower()))
        elif name == "freshness" and value in FRESHNESS:
            found.append(F.col("enriched_at") >= (F.current_timestamp() if as_of is None else as_of) - F.expr(FRESHNESS[value]))
    return reduce(lambda a, b: a & b, [x for x in found if x is not None], F.lit(True))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """A page of an ordered DataFrame, from 1."""
    return rows.offset((max(1, number) - 1) * size).limit(size)


def stale(as_of: Column, weekly: int, monthly: int) -> Column:
    """Observed, and older than its model's interval."""
    digital = filled("business_model").isin(DIGITAL_MODELS)
    older = lambda days: F.col("enriched_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.when(digital, older(weekly)).otherwise(older(monthly)) & F.col("http_status").isNotNull()
