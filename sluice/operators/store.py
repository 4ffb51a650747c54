"""What is stored of listings, as views over append-only events.

An event never changes a row: the current state of a key is the latest of its
events, or the fold that a rule asks for, and a reopening is an event too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes that stay whatever is read later, and the confidence that ends a doubt.
STICKY = ("PLS", "PLUS", "PLAI", "ANRU", "ANAH", "CONVENTIONNE", "SOCIAL")
SURE = 60


def latest(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """(key, columns): those of the last event of each key."""
    last = F.max_by(F.struct(*columns), F.col(order))
    return events.groupBy(key).agg(last.alias("last")).select(key, "last.*")


def twin_tenure(readings: DataFrame) -> DataFrame:
    """(key, tenure, source): the class that a listing takes over from its twins. An
    excluded reading holds for good; a doubt ends only with an eligible reading of
    SURE or more; otherwise the last reading counts. readings has key, seq, tenure,
    source and confidence.

    Folded without a loop: the first excluded reading if there is one; else the last
    doubt if no sure reading follows it; else the last reading."""
    by_key = Window.partitionBy("key")
    doubt = F.max(F.when(F.col("tenure") == "UNKNOWN", F.col("seq"))).over(by_key)
    rows = readings.withColumn("doubt", doubt).withColumn("bad", F.col("tenure").isin(*STICKY))
    what = F.struct("tenure", "source")
    clears = (F.col("seq") > F.col("doubt")) & (F.col("confidence") >= SURE) & ~F.col("bad") & (F.col("tenure") != "UNKNOWN")
    out = rows.groupBy("key").agg(
        F.min_by(what, F.when(F.col("bad"), F.col("seq"))).alias("excluded"),
        F.max_by(what, F.when(F.col("tenure") == "UNKNOWN", F.col("seq"))).alias("doubted"),
        F.coalesce(F.bool_or(clears), F.lit(False)).alias("cleared"),
        F.max_by(what, "seq").alias("last"),
    )
    chosen = F.coalesce("excluded", F.when(~F.col("cleared"), F.col("doubted")), "last")
    return out.select("key", chosen["tenure"].alias("tenure"), chosen["source"].alias("source"))


def reopened(events: DataFrame) -> DataFrame:
    """(key, tenure, dropped): the last reading after the last reopening of each key, and
    how many readings the reopening set aside. events has key, seq, kind (reading or
    reopen) and tenure."""
    cutoff = F.max(F.when(F.col("kind") == "reopen", F.col("seq"))).over(Window.partitionBy("key"))
    rows = events.withColumn("after", F.col("seq") > F.coalesce(cutoff, F.lit(-1))).withColumn("reads", F.col("kind") == "reading")
    live = F.when(F.col("reads") & F.col("after"), F.col("seq"))
    return rows.groupBy("key").agg(F.max_by("tenure", live).alias("tenure"), F.count_if(F.col("reads") & ~F.col("after")).alias("dropped"))


def detail_cache(attempts: DataFrame) -> DataFrame:
    """(key, attempts, fields, fingerprint, last_error, last_at): each page's state after
    all attempts (key, seq, at, ok, fields, fingerprint, error). A failure keeps the
    fields that were read before; a success forgets the last error."""
    good = F.when(F.col("ok"), F.col("seq"))
    return attempts.groupBy("key").agg(
        F.count("*").alias("attempts"),
        F.max_by("fields", good).alias("fields"),
        F.max_by("fingerprint", good).alias("fingerprint"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), "seq").alias("last_error"),
        F.max_by("at", "seq").alias("last_at"),
    )


def detail_failures(cache: DataFrame, group: Column, least: int = 1) -> DataFrame:
    """(source, n): pages of each source that were never read in ``least`` attempts or more."""
    return cache.where(F.col("fields").isNull() & (F.col("attempts") >= least)).groupBy(group.alias("source")).agg(F.count("*").alias("n"))


def open_alerts(events: DataFrame) -> DataFrame:
    """(source, status, at): the last alert of each source and status since the source
    was last well. events has source, id, status and at; OK clears."""
    well = F.max(F.when(F.col("status") == "OK", F.col("id"))).over(Window.partitionBy("source"))
    live = events.withColumn("well", F.coalesce(well, F.lit(-1))).where("status <> 'OK' and id > well")
    return live.groupBy("source", "status").agg(F.max_by("at", "id").alias("at"))


def age(first_seen: Column, now: Column) -> Column:
    """Seconds since a listing was first seen, never below 0; null if it never was."""
    return F.when(first_seen.isNotNull(), F.greatest(F.lit(0), now - first_seen))


def around(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, at, before, after): the last known price at or before an instant and the first
    one after it. points has key, ts, seq and price; asked has (key, at)."""
    rows = asked.join(points, "key", "left")
    order = F.struct("ts", "seq")
    return rows.groupBy("key", "at").agg(
        F.max_by("price", F.when(F.col("ts") <= F.col("at"), order)).alias("before"),
        F.min_by("price", F.when(F.col("ts") > F.col("at"), order)).alias("after"),
    )


def run_totals(judged: DataFrame) -> DataFrame:
    """One row of counts per pass: sources, sources that failed, items, matches, digested,
    rejected. judged has run, source, ok and outcome."""
    return judged.groupBy("run").agg(
        F.countDistinct("source").alias("sources"),
        F.countDistinct(F.when(~F.col("ok"), F.col("source"))).alias("failed"),
        F.count_if(F.col("ok")).alias("items"),
        *[F.count_if(F.col("ok") & (F.col("outcome") == kind)).alias(name) for name, kind in (("matches", "MATCH"), ("digested", "DIGEST"), ("rejected", "REJECT"))],
    )


def kept_tally(calls: DataFrame) -> DataFrame:
    """(pattern, calls, hits) over the cards that yielded a listing; what a card without
    one counted is dropped with it. calls has card, pattern, hit and yields."""
    kept = F.bool_or("yields").over(Window.partitionBy("card"))
    return calls.withColumn("kept", kept).where("kept").groupBy("pattern").agg(F.count("*").alias("calls"), F.count_if(F.col("hit")).alias("hits"))


def escalated(verdicts: DataFrame, misses: DataFrame) -> DataFrame:
    """(source, status): OK becomes WARN_DROP where patterns of the source matched nothing
    at all; any other verdict is worse already and stays."""
    blind = misses.select("source").distinct().withColumn("blind", F.lit(True))
    return verdicts.join(blind, "source", "left").select("source", F.when(F.col("blind") & (F.col("status") == "OK"), "WARN_DROP").otherwise(F.col("status")).alias("status"))


def unreadable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose JSON is missing, empty or can't be parsed: they can't be judged again."""
    return rows.where(F.col(column).isNull() | (F.col(column) == "") | F.try_parse_json(column).isNull())


def seeded(index: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Items of an index that are not known, recorded as announced already: what was on
    sale before the first pass is no news."""
    return index.join(known.select("id"), "id", "left_anti").withColumn("notified_at", now)


def first_passes(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds first: true for a source of which nothing was ever seen."""
    some = seen.select("source").distinct().withColumn("__seen", F.lit(True))
    return sources.join(some, "source", "left").withColumn("first", F.col("__seen").isNull()).drop("__seen")


def duplicate_counts(listings: DataFrame, clusters: DataFrame, group: str) -> DataFrame:
    """(group, harvested, duplicates): listings, and how many of them a cluster already
    holds. clusters has (id, survivor) of listings that have duplicates."""
    gone = clusters.where("id <> survivor").select("id", F.lit(1).alias("__gone"))
    return listings.join(gone, "id", "left").groupBy(group).agg(F.count("*").alias("harvested"), F.count("__gone").alias("duplicates"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Appends attempts to the run log; secrets in errors are masked first."""
    from sluice.functions.text import redact

    runs.withColumn("error", redact(F.col("error"))).write.mode("append").parquet(path)


def walk_checks(pages: DataFrame, declared: DataFrame, page_size: int, most: int = 60) -> DataFrame:
    """(source, problem): what is wrong with a walk over numbered pages, null if nothing.
    Too many pages are declared, the first page is empty though items are declared, or
    pages were lost: fewer items than declared, where a short last page forgives less
    than a page. pages has source, page (from 1) and n; declared has source and total."""
    per = pages.groupBy("source").agg(F.sum("n").alias("n"), F.max_by("n", "page").alias("last"), F.sum(F.when(F.col("page") == 1, F.col("n"))).alias("first"))
    rows = declared.join(per, "source", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "first": F.coalesce("first", F.lit(0))})
    slack = F.when(F.col("last") < page_size, page_size - 1).otherwise(0)
    problem = F.when(F.ceil(F.col("total") / page_size) > most, "too many pages").when((F.col("first") == 0) & (F.col("total") > 0), "no cards").when(F.col("n") + slack < F.col("total"), "lost pages")
    return rows.select("source", problem.alias("problem"))


def lot_windows(lots: DataFrame, sales: DataFrame, now: Column) -> DataFrame:
    """Adds closes and problem to lots (sale, opens, live, countdown; epoch seconds): a
    lot sold live closes with its sale's window (sale, day, closes), another by its own
    countdown. Unknown times, another day and a closing before the opening are
    refused, a closing in the past is no news."""
    rows = lots.join(sales.select("sale", F.col("day").alias("__day"), F.col("closes").alias("__closes")), "sale", "left")
    closes = F.when(F.col("live"), F.col("__closes")).otherwise(F.col("countdown"))
    other_day = F.col("live") & (F.col("__day") != F.date_format(F.timestamp_seconds("opens"), "yyyy-MM-dd"))
    problem = F.when(F.col("opens").isNull(), "no opening").when(closes.isNull(), "no closing").when(other_day, "other day").when(closes <= F.col("opens"), "closes first").when(closes <= now, "closed")
    return rows.withColumns({"closes": closes, "problem": problem}).drop("__day", "__closes")


def digest_cards(mails: DataFrame, pattern: str, groups: tuple[str, ...], key: str, text: str) -> DataFrame:
    """(key, place, groups): every match of one pattern over a whole body, its groups in
    order as columns, blanks collapsed; of a repeated first group the first counts."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(len(groups))]
    rows = mails.select(key, F.posexplode(F.arrays_zip(*[f.alias(g) for f, g in zip(found, groups, strict=True)])).alias("place", "card"))
    rows = rows.select(key, "place", *[F.trim(F.regexp_replace(F.col("card")[g], r"\s+", " ")).alias(g) for g in groups]).where(F.col(groups[0]) != "")
    first = F.min_by(F.struct("place", *groups), "place")
    return rows.groupBy(key, F.col(groups[0]).alias("__id")).agg(first.alias("card")).select(key, "card.*")


def card_lines(cards: DataFrame, text: str, place_pattern: str, pay_pattern: str) -> DataFrame:
    """Adds title, company, location, mode_word, pay_text and labels of a card's lines: the
    first is the title, the second is the place if it has its form (company, location,
    mode), the first line of pay is pay, the rest are labels. A card without lines
    has none of them."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    out = cards.withColumn("__l", lines).withColumn("__p", F.coalesce(F.try_element_at("__l", F.lit(2)).rlike(place_pattern), F.lit(False)))
    part = lambda i: F.when(F.col("__p"), F.trim(F.regexp_extract(F.try_element_at("__l", F.lit(2)), place_pattern, i)))
    all_ = F.coalesce(F.size("__l"), F.lit(0))
    rest = F.slice("__l", F.when(F.col("__p"), 3).otherwise(2), F.greatest(F.lit(0), all_))
    out = out.withColumns({"title": F.try_element_at("__l", F.lit(1)), "company": part(1), "location": part(2), "mode_word": F.nullif(part(3), F.lit("")), "__r": rest})
    at = F.array_position(F.transform("__r", lambda l: l.rlike(pay_pattern)), True)
    pay = F.when(at > 0, F.try_element_at("__r", at.cast("int")))
    labels = F.filter("__r", lambda l, i: i != at - 1)
    return out.withColumns({"pay_text": pay, "labels": F.array_join(labels, " | ")}).drop("__l", "__p", "__r")
