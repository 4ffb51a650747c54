import datetime as dt
import random

from pyspark.sql import functions as F

from sluice.streaming import hydration

SCHEMA = "key string, seq long, at timestamp, event string"


def log(pages):
    """Pages that are seen, then tried when they are due; some are read, some fail."""
    draw, rows, start = random.Random(3), [], dt.datetime(2024, 1, 1)
    for p in range(pages):
        at = start + dt.timedelta(minutes=7 * p)
        rows.append((f"p{p}", at, "seen"))
        for _ in range(draw.randint(0, 4)):
            at += dt.timedelta(minutes=20)
            good = draw.random() < 0.3
            rows.append((f"p{p}", at, "read" if good else "failed"))
            if good:
                break
            at += dt.timedelta(hours=6, minutes=20)
    rows.append(("end", start + dt.timedelta(days=9), "seen"))
    return [(k, i, at, e) for i, (k, at, e) in enumerate(sorted(rows, key=lambda r: r[1]))]


def test_stream_equals_log(spark, tmp_path):
    rows = log(30)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(0, len(rows), 20):
            spark.createDataFrame(rows[i : i + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = hydration.due_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    order = lambda df: sorted((r["key"], r["attempt"], r["due"]) for r in df.collect())
    got, want = order(spark.read.parquet(str(tmp_path / "out"))), order(hydration.due_log(spark.createDataFrame(rows, SCHEMA)))
    assert got == want and max(r[1] for r in got) == hydration.ATTEMPTS


def test_rules_of_a_log(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", 0, at(0), "seen"), ("a", 1, at(1), "failed"), ("a", 2, at(8), "failed"), ("a", 3, at(15), "failed"), ("a", 4, at(30), "seen"), ("b", 5, at(0), "seen"), ("b", 6, at(1), "failed"), ("b", 7, at(3), "read"), ("c", 8, at(0), "seen"), ("end", 9, at(99), "seen")]
    got = sorted((r["key"], r["attempt"], r["due"]) for r in hydration.due_log(spark.createDataFrame(rows, SCHEMA)).where(F.col("key") != "end").collect())
    assert got == [("a", 1, at(0)), ("a", 2, at(7)), ("a", 3, at(14)), ("b", 1, at(0)), ("c", 1, at(0))]
