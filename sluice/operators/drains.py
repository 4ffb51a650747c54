"""Queues of what waits to be announced, and the texts that announce it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.rank import place

#: Entries that one announcement holds.
BATCH = 50


def pending(rows: DataFrame, outcome: str, limit: int = BATCH) -> DataFrame:
    """The oldest rows of an outcome that were not announced: a top-k by time and key."""
    return rows.where((F.col("outcome") == outcome) & F.col("notified_at").isNull()).orderBy("seen", "key").limit(limit)


def budgeted(rows: DataFrame, group: str, priority: Column, budget: int) -> DataFrame:
    """The first ``budget`` rows of each group by priority and key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(priority, "key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= budget)


def counts(rows: DataFrame) -> DataFrame:
    """(outcome, n, notified, waiting)."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count("notified_at").alias("notified"), F.sum(F.col("notified_at").isNull().cast("long")).alias("waiting"))


def split_queue(rows: DataFrame, push_min: int) -> DataFrame:
    """Adds route: a queued match at or above the gate is a failed push to retry."""
    return rows.withColumn("route", F.when(F.col("score") >= push_min, "retry").otherwise("batch"))


def delivered(results: DataFrame) -> DataFrame:
    """(key, delivered): true if a channel that reaches somebody did not fail."""
    return results.groupBy("key").agg(F.coalesce(F.bool_or(F.col("reaches") & ~F.col("failed")), F.lit(False)).alias("delivered"))


def stale(rows: DataFrame, tenures: tuple[str, ...] = ("UNKNOWN",)) -> DataFrame:
    """Rows whose class is missing or one of ``tenures``, to be judged again, with their
    place: the latest seen first."""
    open_ = rows.where(F.col("tenure").isNull() | F.col("tenure").isin(*tenures))
    return place(open_, [F.desc("seen"), F.col("key")], "place")


def sendable(entries: DataFrame, refused: DataFrame) -> DataFrame:
    """Entries that no route refuses at the last moment; refused has key and route."""
    return entries.join(refused.where("route is not null").select("key"), "key", "left_anti")


def overflow(waiting: Column, announced: Column, waiting_low: Column, drained: Column) -> Column:
    """What still waits behind an announcement, of both queues."""
    return F.greatest(F.lit(0), waiting - announced) + F.greatest(F.lit(0), waiting_low - drained)


def daily_drain(rows: DataFrame, refused: DataFrame, push_min: int, delivered_: bool = True, limit: int = BATCH) -> DataFrame:
    """(key, action, kind) of every waiting row. What any route refuses stays. A match
    at or above the gate is a failed push and is pushed again by itself; of the other
    matches and of what is for the digest the oldest ``limit`` each go into one
    message and the rest overflows. kind is what a row is announced as from now on:
    null if it isn't, and nothing of a message that was not delivered is."""
    open_ = rows.where(F.col("notified_at").isNull() & F.col("outcome").isin("MATCH", "DIGEST"))
    open_ = open_.join(refused.where("route is not null").select("key", F.lit(True).alias("no")), "key", "left")
    queue = F.when(F.col("no"), "refused").when((F.col("outcome") == "MATCH") & (F.col("score") >= push_min), "retry").when(F.col("outcome") == "MATCH", "rollup").otherwise("digest")
    out = open_.withColumn("queue", queue).select("key", "seen", "queue")
    batched = F.col("queue").isin("rollup", "digest")
    # The first of either queue are two top-ks; nothing else has to be put in order.
    first = [out.where(F.col("queue") == q).orderBy("seen", "key").limit(limit).select("key", F.lit(True).alias("first")) for q in ("rollup", "digest")]
    out = out.join(F.broadcast(first[0].union(first[1])), "key", "left")
    out = out.withColumn("action", F.when(batched & F.col("first").isNull(), "overflow").otherwise(F.col("queue")))
    sent = F.lit(delivered_) & batched & (F.col("action") == F.col("queue"))
    return out.select("key", "action", F.when(F.col("action") == "retry", "MATCH").when(sent, F.upper("queue")).alias("kind"))


def headline(title: Column, price: Column, score: Column) -> Column:
    from sluice.functions.text import french_number

    return F.concat_ws(" · ", title, F.concat(french_number(price), F.lit(" €")), F.concat(F.lit("score "), score.cast("string")))


def drop_line(title: Column, previous: Column, price: Column) -> Column:
    """A price that fell: both figures and the difference in euros and per cent."""
    from sluice.functions.text import french_number

    percent = F.round((previous - price) * 100 / previous, 0).cast("int").cast("string")
    return F.concat(title, F.lit(" : "), french_number(previous), F.lit(" € → "), french_number(price), F.lit(" € (−"), french_number(previous - price), F.lit(" €, −"), percent, F.lit(" %)"))


def health_line(source: Column, status: Column, recovered: Column) -> Column:
    return F.when(recovered, F.concat(source, F.lit(" : rétablie"))).otherwise(F.concat(source, F.lit(" : "), status))


def heartbeat_line(sources: Column, items: Column, matches: Column) -> Column:
    return F.concat_ws(" · ", F.concat(sources.cast("string"), F.lit(" sources")), F.concat(items.cast("string"), F.lit(" annonces")), F.concat(matches.cast("string"), F.lit(" retenues")))


def message(lines: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(batch, text): one message of each batch, a section for each queue that has lines
    (title and count, then its lines in order of place). lines has batch, queue, place
    and line; a batch is bounded by its drain."""
    heads = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
    orders = F.create_map(*[F.lit(x) for i, name in enumerate(titles) for x in (name, i)])
    per = lines.groupBy("batch", "queue").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("all"))
    section = F.concat(heads[F.col("queue")], F.lit(" ("), F.size("all").cast("string"), F.lit(")\n"), F.array_join(F.transform("all", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    whole = F.array_sort(F.collect_list(F.struct(orders[F.col("queue")].alias("place"), section.alias("text"))))
    return per.groupBy("batch").agg(F.array_join(F.transform(whole, lambda x: x["text"]), "\n\n").alias("text"))
