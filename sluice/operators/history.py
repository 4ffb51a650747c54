"""Price history and the fold of observations into a current row per key."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_points(observations: DataFrame) -> DataFrame:
    """(key, ts, seq, price, previous): observations whose price differs from the
    last known one before them in event time; unknown prices are no change."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    known = observations.where("price is not null").withColumn("previous", F.lag("price").over(w))
    return known.where("previous is null or previous <> price").select("key", "ts", "seq", "price", "previous")


def recorded(observations: DataFrame) -> DataFrame:
    """(key, ts, seq, price): the history that is written down as observations (key, seq, ts,
    price) arrive in order of seq, which may be late. One is written if its price differs
    from the one recorded last before its time and from the one recorded next after it;
    nothing that was written is taken back. Of equal times the earlier arrival comes
    first. Unknown prices, keys and times write nothing.

    What is written depends on all that was written before, so a key is read in one go;
    its rows stream past and only its change points are held.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times, prices = None, [], []
        for batch in batches:
            kept = []
            for i, (key, ts, price) in enumerate(zip(batch["key"].to_pylist(), batch["ts"].cast(pa.int64()).to_pylist(), batch["price"].to_pylist(), strict=True)):
                if key != now:
                    now, times, prices = key, [], []
                at = bisect_right(times, ts)
                if (not at or prices[at - 1] != price) and (at == len(times) or prices[at] != price):
                    times.insert(at, ts)
                    prices.insert(at, price)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    known = observations.where("key is not null and ts is not null and price is not null").select("key", "ts", "seq", "price")
    return known.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(write, known.schema)


def drops(points: DataFrame) -> DataFrame:
    """Change points that go down, with delta (negative)."""
    return points.withColumn("delta", F.col("price") - F.col("previous")).where("delta < 0")


def notable(drop: Column, previous: Column, euros: float, percent: float) -> Column:
    """A drop of so many euros or so many percent at least."""
    return (-drop >= euros) | (F.when(previous > 0, -drop * 100 / previous) >= percent)


def crossed(previous: Column, price: Column, ceiling: float) -> Column:
    """From above the ceiling to it or below."""
    return F.coalesce((previous > ceiling) & (price <= ceiling), F.lit(False))


def last_price(observations: DataFrame) -> DataFrame:
    """(key, price): the latest by time and arrival."""
    return observations.where("price is not null").groupBy("key").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))


def series(observations: DataFrame) -> DataFrame:
    """(key, prices): prices in order of time and arrival; a key's history is one row."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "price")))
    return observations.groupBy("key").agg(F.transform(ordered, lambda x: x["price"]).alias("prices"))


def fold(observations: DataFrame, late: str = "fill") -> DataFrame:
    """(key, seen, price, title, n_late): current row per key after observations in
    order of arrival (seq). A current one, whose time is not before the last seen
    time, overwrites with what it knows; a late one fills blanks only (late =
    "fill") or changes nothing ("ignore"). Declarative: the times at arrival are a
    running maximum, the values are the latest of the current ones, blanks the
    earliest late ones."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = observations.withColumn("seen", F.max("ts").over(before)).withColumn("late", F.coalesce(F.col("ts") < F.col("seen"), F.lit(False)))
    out = [F.max("ts").alias("seen")]
    for name in ("price", "title"):
        known = F.col(name).isNotNull()
        value = F.max_by(F.when(~F.col("late"), F.col(name)), F.when(known & ~F.col("late"), F.col("seq")))
        if late == "fill":
            value = F.coalesce(value, F.min_by(F.when(F.col("late"), F.col(name)), F.when(known & F.col("late"), F.col("seq"))))
        out.append(value.alias(name))
    return marked.groupBy("key").agg(*out, F.sum(F.col("late").cast("long")).alias("n_late"))


def fold_arrivals(rows: pd.DataFrame, state: tuple | None, late: str = "fill") -> tuple:
    """One key's observations, in order of arrival, into (seen, price, title, n_late)."""
    seen, price, title, n_late = state or (None, None, None, 0)
    for r in rows.sort_values("seq").itertuples(index=False):
        if seen is not None and r.ts < seen:
            n_late += 1
            if late == "fill":
                price = r.price if price is None and pd.notna(r.price) else price
                title = r.title if title is None and r.title is not None else title
            continue
        seen = r.ts
        price = r.price if pd.notna(r.price) else price
        title = r.title if r.title is not None else title
    return seen, price, title, n_late


def dedup_key(source: Column, external_id: Column, url: Column, title: Column) -> Column:
    """source:id:<percent-encoded id>, else source:h:<hash of url and title>, else null."""
    from sluice.functions.text import normalise_url, percent_encode

    by_id = F.concat(source, F.lit(":id:"), percent_encode(F.when(F.trim(external_id) != "", external_id)))
    by_text = F.concat(source, F.lit(":h:"), F.sha2(F.concat(normalise_url(url), F.lit("\n"), F.trim(title)), 256))
    return F.coalesce(by_id, by_text)


def content_id(*facts: Column) -> Column:
    """sha1 of facts joined by a pipe; an unknown fact is an empty one."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in facts]))


#: Ranks of announcements; a later lower one never takes a higher one back.
ANNOUNCED = {"DIGEST": 1, "ROLLUP": 2, "MATCH": 3}


def announced(events: DataFrame) -> DataFrame:
    """(key, rank, at): the highest announcement of each key and the time of the last one."""
    rank = F.lit(3)
    for kind, value in ANNOUNCED.items():
        rank = F.when(F.col("kind") == kind, value).otherwise(rank)
    return events.groupBy("key").agg(F.max(rank).cast("int").alias("rank"), F.max("at").alias("at"))


def durable(readings: DataFrame) -> DataFrame:
    """(key, tenure): an excluded reading holds against any later one, else the latest."""
    return readings.groupBy("key").agg(F.coalesce(F.max_by(F.when(F.col("excluded"), F.col("tenure")), F.when(F.col("excluded"), F.col("seq"))), F.max_by("tenure", "seq")).alias("tenure"))
