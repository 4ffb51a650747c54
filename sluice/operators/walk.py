"""Walks over the result pages of sources: the union of their cards, or nothing.

A page that is lost in the middle of a walk looks like a quiet market, so a walk counts only
as a whole: every declared page arrived, each has cards, and their number is within a
page of what the source says it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.session import cut
from sluice.sources import selectors

#: Faults that an error names.
NAMED = 20


class BrokenWalk(ValueError):
    """A walk of some source is not whole."""


def cards(pages: DataFrame, item: str, fields: dict[str, str]) -> DataFrame:
    """(source, page, place, fields) of all cards of ``pages`` (source, page, url, html). Pages
    are told apart by source and number, whatever their address."""
    key = F.to_json(F.struct("source", "page"))
    found = selectors.select(pages.select(key.alias("url"), "html"), item, fields)
    of = F.from_json("url", pages.select("source", "page").schema)
    return found.select(of["source"].alias("source"), of["page"].alias("page"), "place", "fields")


def faults(pages: DataFrame, found: DataFrame, declared: DataFrame, page_size: int) -> DataFrame:
    """(source, lost, empty, missing) of the sources of ``declared`` (source, pages, total) whose
    walk is not whole: pages that did not arrive (without html or at all), pages that
    arrived without cards, and cards short of the total by a page or more. A source that
    declares no number of pages or no total is not measured by it."""
    arrived = pages.where("html is not null").groupBy("source").agg(F.count_distinct("page").alias("arrived"))
    held = found.groupBy("source").agg(F.count_distinct("page").alias("held"), F.count("*").alias("n"))
    rows = declared.join(arrived, "source", "left").join(held, "source", "left")
    none = F.lit(0).cast("long")
    got, full, n = (F.coalesce(c, none) for c in ("arrived", "held", "n"))
    least = F.greatest(none, F.col("total") - (page_size - 1))
    rows = rows.select("source", F.greatest(none, F.coalesce(F.col("pages") - got, none)).alias("lost"), (got - full).alias("empty"), F.greatest(none, F.coalesce(least - n, none)).alias("missing"))
    return rows.where("lost > 0 or empty > 0 or missing > 0")


def write(pages: DataFrame, declared: DataFrame, item: str, fields: dict[str, str], page_size: int, path: str) -> None:
    """Appends the cards of all sources to ``path``, or raises BrokenWalk and writes nothing."""
    found = cut(cards(pages, item, fields))
    broken = faults(pages, found, declared, page_size).orderBy("source").limit(NAMED).collect()
    if broken:
        raise BrokenWalk("; ".join(f"{r['source']}: {r['lost']} pages lost, {r['empty']} empty, {r['missing']} cards missing" for r in broken))
    found.write.mode("append").parquet(path)
