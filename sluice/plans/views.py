"""The given tables as the listings, runs and queues that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a small table in one file would be one task, which is slow
    where texts are read. A table of more parts than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as car listings; small sizes have no known age, one type no known body."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("key"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") > 2, F.col("p_size") / 5.0).alias("age"),
        (F.col("p_size") * 3000.0).alias("mileage"),
        F.when(F.col("p_partkey") % 3 == 0, "automatique").when(F.col("p_partkey") % 3 == 1, "manuelle").alias("gearbox"),
        F.element_at(F.array(*map(F.lit, ("essence", "diesel", "gpl", "hybride"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("fuel"),
        F.when(F.col("p_type") != "MEDIUM", F.col("p_type")).alias("body"),
        F.col("p_brand").alias("make"),
        F.when(F.col("p_partkey") % 10 != 0, F.lpad((F.col("p_partkey") % 100 * 1000).cast("string"), 5, "0")).alias("postcode"),
        F.col("p_name").alias("text"),
        (F.col("p_partkey") % 50 == 0).alias("hail"),
    )


CARS_SQL = """cars AS (SELECT p_partkey AS key, p_retailprice AS price,
  CASE WHEN p_size > 2 THEN p_size / 5.0 END AS age, p_size * 3000.0 AS mileage,
  CASE WHEN p_partkey % 3 = 0 THEN 'automatique' WHEN p_partkey % 3 = 1 THEN 'manuelle' END AS gearbox,
  (['essence', 'diesel', 'gpl', 'hybride'])[p_partkey % 4 + 1] AS fuel,
  CASE WHEN p_type <> 'MEDIUM' THEN lower(p_type) END AS body, lower(p_brand) AS make,
  CASE WHEN p_partkey % 10 <> 0 THEN lpad(CAST(p_partkey % 100 * 1000 AS VARCHAR), 5, '0') END AS postcode,
  p_partkey % 50 = 0 AS hail FROM part)"""


def flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rental listings; a discount of none leaves the rent unknown, a tax
    of none the floor. The id is a digest of order, line, part and supplier, 60 bits of it."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.conv(F.left(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").cast("binary")), F.lit(15)), 16, 10).cast("long").alias("id"),
        F.col("l_partkey").cast("string").alias("commune"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("rent"),
        F.col("l_quantity").alias("surface"),
        F.col("l_linenumber").alias("rooms"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 100, 0).cast("int")).alias("floor"),
        F.col("l_returnflag").alias("source"),
        F.when(F.col("l_linestatus") == "O", "institutional").otherwise("private").alias("family"),
    )


FLATS_SQL = """flats AS (SELECT CAST('0x' || left(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 15) AS BIGINT) AS id, CAST(l_partkey AS VARCHAR) AS commune,
  CASE WHEN l_discount > 0 THEN l_extendedprice END AS rent, l_quantity AS surface, l_linenumber AS rooms,
  CASE WHEN l_tax > 0 THEN CAST(round(l_tax * 100) AS INTEGER) END AS floor, l_returnflag AS source,
  CASE WHEN l_linestatus = 'O' THEN 'institutional' ELSE 'private' END AS family FROM lineitem),
same AS (SELECT a.id AS a, b.id AS b, a.source AS sa, b.source AS sb, a.family AS fa, b.family AS fb FROM flats a JOIN flats b ON a.commune = b.commune AND a.id < b.id
  WHERE (a.rent IS NULL OR b.rent IS NULL OR abs(a.rent - b.rent) <= 30 OR abs(a.rent - b.rent) / greatest(a.rent, b.rent) <= 0.03)
  AND (abs(a.surface - b.surface) <= 2 OR abs(a.surface - b.surface) / greatest(a.surface, b.surface) <= 0.03)
  AND a.rooms = b.rooms AND (a.floor IS NULL OR b.floor IS NULL OR a.floor = b.floor))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: k from 25 on is a success, forty of value are one item."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("source"),
        F.col("event_id").alias("id"),
        F.unix_timestamp("ts").alias("at"),
        (F.get_json_object("props", "$.k").cast("int") >= 25).alias("ok"),
        F.floor(F.col("value") / 40).cast("int").alias("items"),
        F.lit(None).cast("long").alias("feed_at"),
    )


RUNS_SQL = """runs AS (SELECT user_id AS source, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS "at",
  CAST(json_extract_string(props, '$.k') AS INTEGER) >= 25 AS ok, CAST(floor(value / 40) AS INTEGER) AS items FROM events)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price observations; errors have no price."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.round("value", 0)).alias("price"), F.when(F.col("event_type") == "view", F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("title"))


PRICES_SQL = """obs AS (SELECT user_id AS key, ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN round(value, 0) END AS price,
  CASE WHEN event_type = 'view' THEN 't' || event_id END AS title FROM events),
known AS (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY ts, seq) AS previous FROM obs WHERE price IS NOT NULL),
points AS (SELECT * FROM known WHERE previous IS NULL OR previous <> price)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as announcements: status is the outcome, urgent ones were announced."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderdate").alias("seen"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")).alias("notified_at"), F.col("o_custkey").alias("source"))


QUEUE_SQL = """queue AS (SELECT o_orderkey AS key, o_orderstatus AS outcome, o_orderdate AS seen, CAST(floor(o_totalprice / 5000) AS INTEGER) AS score,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS notified_at, o_custkey AS source FROM orders)"""
