"""Detail pages to be fetched, as keyed state with timers: a page that failed is due again
after a while, up to a number of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Attempts at a page, and seconds from a failure to the next one.
ATTEMPTS, WAIT = 3, 6 * 3600
DUE = "key string, attempt int, due timestamp"


class _Pages(StatefulProcessor):
    """The state of a page is the number of its failures; -1 is a page that was read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int")

    def _known(self) -> int | None:
        return self.failures.get()[0] if self.failures.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"])
        out = []
        for at, event in zip(events["at"], events["event"], strict=True):
            n = self._known()
            # The watermark follows behind: what came due before this event comes first.
            for timer in [t for t in self.handle.listTimers() if event == "read" or t <= at.timestamp() * 1000]:
                self.handle.deleteTimer(timer)
                if timer <= at.timestamp() * 1000:
                    out.append((key[0], n + 1, pd.Timestamp(timer, unit="ms")))
            if event == "seen" and n is None:
                self.failures.update((0,))
                out.append((key[0], 1, at))
            elif event == "read":
                self.failures.update((-1,))
            elif event == "failed" and n is not None and n >= 0:
                self.failures.update((n + 1,))
                if n + 1 < ATTEMPTS:
                    self.handle.registerTimer(int(at.timestamp() + WAIT) * 1000)
        yield pd.DataFrame(out, columns=["key", "attempt", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self._known()
        due = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], n + 1, due)] if n is not None and 0 <= n < ATTEMPTS else [], columns=["key", "attempt", "due"])

    def close(self) -> None:
        pass


def due_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(key, attempt, due) of a stream of events (key, seq, at timestamp, event: seen, failed
    or read): each page when it is first seen, and WAIT after a failure once the
    watermark is past that, as long as it wasn't read and has attempts left."""
    rows = events.select("key", "seq", "at", "event").withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Pages(), DUE, "append", "eventTime")


def due_log(events: DataFrame) -> DataFrame:
    """The same of a whole log, up to its last event: what due_stream() gives for events
    that arrive in order, if a page is tried when it is due and not before. Failures
    before a page is seen and whatever follows its reading count for nothing."""
    w, key = Window.partitionBy("key").orderBy("at", "seq"), Window.partitionBy("key")
    of = lambda kind: F.min(F.when(F.col("event") == kind, F.struct("at", "seq"))).over(key)
    marked = events.withColumns({"first": of("seen"), "read": of("read"), "place": F.struct("at", "seq")})
    marked = marked.where((F.col("place") >= F.col("first")) & (F.col("read").isNull() | (F.col("place") < F.col("read"))))
    marked = marked.withColumn("n", F.sum((F.col("event") == "failed").cast("int")).over(w))
    seen = marked.where((F.col("event") == "seen") & (F.col("place") == F.col("first"))).select("key", F.lit(1).alias("attempt"), F.col("at").alias("due"))
    failed = marked.where((F.col("event") == "failed") & (F.col("n") < ATTEMPTS)).withColumn("due", F.col("at") + F.make_dt_interval(secs=F.lit(WAIT)))
    open_ = failed.where(F.col("read").isNull() | (F.col("read.at") >= F.col("due")))
    end = events.agg(F.max("at").alias("end"))
    return seen.union(open_.join(F.broadcast(end), F.col("due") < F.col("end")).select("key", (F.col("n") + 1).cast("int").alias("attempt"), "due"))
