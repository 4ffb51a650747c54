"""Streams: the observation fold as keyed state, and announcements once delivered."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.history import fold_arrivals
from sluice.plans.session import cut

OUT = "key long, seen timestamp, price double, title string, n_late long"
STATE = "seen timestamp, price double, title string, n_late long"


def fold_stream(observations: DataFrame, late: str = "fill") -> DataFrame:
    """The current row of each key that a micro-batch touches. Late observations are
    merged by what the state has seen; no watermark drops them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        now = fold_arrivals(rows, None if old is None else (pd.Timestamp(old[0]) if old[0] is not None else None, *old[1:]), late)
        state.update((None if now[0] is None else pd.Timestamp(now[0]).to_pydatetime(), None if now[1] is None else float(now[1]), now[2], int(now[3])))
        yield pd.DataFrame([(key[0], *now)], columns=["key", "seen", "price", "title", "n_late"])

    return observations.groupBy("key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


#: Kinds of announcement, a higher one after a lower one is news.
RANKS = ("DIGEST", "MATCH")
LOG = "key long, kind string, at timestamp, channel string, stream string, batch long"


def announce(frame: DataFrame, channels: dict[str, Callable[[DataFrame, int], DataFrame]], log_path: str, checkpoint: str, delivered: Callable[[str, DataFrame], DataFrame] | None = None):
    """Starts a query that sends each row of ``frame`` (key, kind) once over every channel.

    A batch has two phases for a channel: what is to be sent is written down as intended,
    then it is sent, and what the channel confirms is written down as announced. A key
    that was announced there in a kind as high or higher is left out; one key in a batch
    counts once, in its highest kind. A batch that is repeated after a failure finds
    its intentions: rows that were intended and not confirmed may have been sent. They are
    sent again only if ``delivered`` (of a channel and those rows, it gives those that
    arrived) says that they didn't arrive; without it they count as sent. Rows that a
    channel did not confirm are due whenever they come again. Each batch writes
    to folders of its own, so a repeated write replaces itself.
    """
    spark = frame.sparkSession
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    rank = lambda kind: F.array_position(F.lit(list(RANKS)), kind)

    def log(phase: str) -> DataFrame:
        return spark.read.schema(LOG).parquet(f"{log_path}/{phase}")

    def write(rows: DataFrame, phase: str, channel: str, number: int) -> None:
        path = f"{log_path}/{phase}/channel={channel}/stream={stream}/batch={number}"
        rows.select("key", "kind", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(path)

    def over(channel: str, send: Callable, rows: DataFrame, number: int) -> None:
        told = log("announced").where((F.col("channel") == channel) & ~((F.col("stream") == stream) & (F.col("batch") == number)))
        told = told.groupBy("key").agg(F.max(rank(F.col("kind"))).alias("told"))
        due = rows.groupBy("key").agg(F.max_by("kind", rank(F.col("kind"))).alias("kind"))
        due = cut(due.join(told, "key", "left").where(F.col("told").isNull() | (rank(F.col("kind")) > F.col("told"))).select("key", "kind"))
        mine = (F.col("channel") == channel) & (F.col("stream") == stream) & (F.col("batch") == number)
        doubtful = cut(due.join(log("intended").where(mine).select("key"), "key", "left_semi"))
        arrived = doubtful if delivered is None or doubtful.isEmpty() else cut(delivered(channel, doubtful).select("key", "kind"))
        if doubtful.isEmpty():
            write(due, "intended", channel, number)
        again = due.join(arrived.select("key"), "key", "left_anti") if not doubtful.isEmpty() else due
        write(arrived.unionByName(send(again, number).select("key", "kind")), "announced", channel, number)

    def batch(rows: DataFrame, number: int) -> None:
        rows = cut(rows.select("key", "kind"))
        for channel, send in channels.items():
            over(channel, send, rows, number)

    for phase in ("intended", "announced"):
        spark.createDataFrame([], LOG).write.mode("ignore").partitionBy("channel", "stream", "batch").parquet(f"{log_path}/{phase}")
    return frame.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_due(now, marker, hour: int, zone: str):
    """Column: true if the local day's hour has come and the marker is not from after
    it; a missing or future marker is due."""
    local = F.from_utc_timestamp(now, zone)
    opened = F.to_utc_timestamp(F.date_trunc("day", local) + F.make_interval(hours=F.lit(hour)), zone)
    opened = F.when(opened > now, F.to_utc_timestamp(F.date_trunc("day", local) - F.make_interval(days=F.lit(1)) + F.make_interval(hours=F.lit(hour)), zone)).otherwise(opened)
    return F.coalesce((marker > now) | (marker < opened), F.lit(True))
