import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import history
from sluice.streaming import folds

SCHEMA = "key long, ts timestamp, seq long, price double, title string"


def test_stream_equals_batch(spark, tmp_path):
    draw = random.Random(2)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randint(0, 9)), s, draw.choice([None, 1.0, 2.0]), draw.choice([None, "a"])) for s, k in enumerate(draw.choices(range(8), k=90))]
    for i in range(3):
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = folds.fold_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = {r["key"]: (r["price"], r["title"], r["n_late"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()}
    want = {r["key"]: (r["price"], r["title"], r["n_late"]) for r in history.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def announced(spark, tmp_path, channels, name="cp", **options):
    stream = spark.readStream.schema("key long, kind string").parquet(str(tmp_path / "in"))
    folds.announce(stream, channels, str(tmp_path / "log"), str(tmp_path / name), **options).awaitTermination()


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, "key long, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def recorder(sent, confirms=lambda rows: rows, fail=None):
    def send(rows, number):
        sent.append(sorted((r["key"], r["kind"]) for r in rows.collect()))
        if fail and fail.pop("now", False):
            raise OSError("lost after sending")
        return confirms(rows)

    return send


def test_announced_once_after_delivery(spark, tmp_path):
    arrive(spark, tmp_path, [(i, "MATCH") for i in range(6)] + [(0, "DIGEST")])
    sent = []
    announced(spark, tmp_path, {"push": recorder(sent, lambda rows: rows.where("key < 4"))}, "cp0")
    announced(spark, tmp_path, {"push": recorder(sent)}, "cp1")
    announced(spark, tmp_path, {"push": recorder(sent)}, "cp2")
    assert sent == [[(i, "MATCH") for i in range(6)], [(4, "MATCH"), (5, "MATCH")], []]


def test_a_failure_between_sending_and_writing_sends_once(spark, tmp_path):
    arrive(spark, tmp_path, [(1, "MATCH"), (2, "DIGEST")])
    sent, fail = [], {"now": True}
    with pytest.raises(Exception, match="lost after sending"):
        announced(spark, tmp_path, {"push": recorder(sent, fail=fail)})
    announced(spark, tmp_path, {"push": recorder(sent)})
    assert [x for x in sent if x] == [[(1, "MATCH"), (2, "DIGEST")]]
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "log" / "announced")).collect()) == [1, 2]


def test_a_channel_that_knows_what_arrived_gets_the_rest(spark, tmp_path):
    arrive(spark, tmp_path, [(1, "MATCH"), (2, "MATCH")])
    sent, fail = [], {"now": True}
    with pytest.raises(Exception, match="lost after sending"):
        announced(spark, tmp_path, {"push": recorder(sent, fail=fail)})
    announced(spark, tmp_path, {"push": recorder(sent)}, delivered=lambda channel, rows: rows.where("key = 1"))
    assert sent == [[(1, "MATCH"), (2, "MATCH")], [(2, "MATCH")]]


def test_each_channel_has_its_own_log_and_a_higher_kind_is_news(spark, tmp_path):
    push, mail = [], []
    channels = {"push": recorder(push), "mail": recorder(mail, lambda rows: rows.where("key <> 1"))}
    arrive(spark, tmp_path, [(1, "DIGEST"), (2, "MATCH")])
    announced(spark, tmp_path, channels)
    arrive(spark, tmp_path, [(1, "MATCH"), (2, "DIGEST"), (3, "DIGEST")])
    announced(spark, tmp_path, channels)
    arrive(spark, tmp_path, [(1, "MATCH")])
    announced(spark, tmp_path, channels)
    assert push == [[(1, "DIGEST"), (2, "MATCH")], [(1, "MATCH"), (3, "DIGEST")], []]
    assert mail == [[(1, "DIGEST"), (2, "MATCH")], [(1, "MATCH"), (3, "DIGEST")], [(1, "MATCH")]]


def test_daily_window(spark):
    rows = [("2024-06-01 05:59:00", "2024-05-31 06:10:00", False), ("2024-06-01 06:00:00", "2024-05-31 06:10:00", True), ("2024-06-01 07:00:00", "2024-06-01 06:01:00", False), ("2024-06-01 07:00:00", None, True), ("2024-06-01 07:00:00", "2024-06-02 00:00:00", True)]
    df = spark.createDataFrame(rows, "now string, marker string, want boolean")
    got = df.select("want", folds.daily_due(F.to_timestamp("now"), F.to_timestamp("marker"), 8, "Europe/Paris").alias("due")).collect()
    assert all(r["want"] == r["due"] for r in got)
