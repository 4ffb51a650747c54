"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.session import cut

__all__ = ["BROADCAST", "connected_components", "cut", "fresh", "lookup_join", "map_rows", "read", "row_key", "stream_shards", "text_bytes"]

#: Rows of a few numbers that may be broadcast (some 30 MB on an executor).
BROADCAST = 400_000
#: Rows of a batch that a Python worker holds objects of at once.
SLICE = 1024
#: Links of two numbers that one partition may hold (some 2 MB); more are shuffled.
FEW_LINKS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that
    name (columns are told apart without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lookup_join(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """``df`` joined with ``ids`` (``on`` and few more columns), which are counted
    first: up to BROADCAST rows are broadcast and ``df`` stays where it is, more
    are joined by a shuffle."""
    ids = cut(ids)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, on, how)


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def row_key() -> Column:
    """One key for rows with the same doc_id and text."""
    return F.xxhash64("doc_id", "text")


def map_rows(df: DataFrame, each: Callable[[dict], Iterator[tuple]], schema: str, rows: int = SLICE) -> DataFrame:
    """Arrow batches in, Arrow batches out. ``each`` gets ``rows`` rows at a time as a
    dict of Arrow arrays and yields a tuple of columns (lists or Arrow arrays) in the
    order of ``schema``. What Arrow holds is given back at the end of a task, since
    workers live on."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            for columns in each({n: batch.column(i) for i, n in enumerate(batch.schema.names)}):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def stream_shards(held: DataFrame, asked: DataFrame, keys: list[str], order: str, build: Callable, answer: Callable, schema: str) -> DataFrame:
    """Brings rows of ``asked`` to the shard of ``held`` with the same ``keys``. Each
    shard is shuffled and put together once: ``build`` gets its rows (an Arrow table,
    sorted by ``order``), then ``answer`` gets what it made and the rows asked,
    batch by batch, and returns columns in the order of ``schema``. One shard and
    one batch are in memory at a time; rows asked of no shard are answered nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rest = [[c for c in df.columns if c not in keys] for df in (held, asked)]
    left = held.select(*keys, F.lit(0).alias("side"), F.col(order).alias("place"), F.struct(*rest[0]).alias("held"))
    right = asked.select(*keys, F.lit(1).alias("side"), F.lit(None).cast(left.schema["place"].dataType).alias("place"), F.struct(*rest[1]).alias("asked"))
    rows = left.unionByName(right, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "side", "place")

    def table(batch: pa.RecordBatch, name: str) -> pa.Table:
        return pa.Table.from_struct_array(batch.column(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, made = None, [], None
        for batch in batches:
            marks = list(zip(*[batch.column(k).to_pylist() for k in (*keys, "side")], strict=True))
            at = 0
            while at < len(marks):
                end = at + 1
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                *key, side = marks[at]
                part = batch.slice(at, end - at)
                if key != now:
                    now, waiting, made = key, [], None
                if side == 0:
                    waiting.append(table(part, "held"))
                else:
                    if waiting:
                        made, waiting = build(pa.concat_tables(waiting)), []
                    if made is not None:
                        found = answer(made, table(part, "asked"))
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)
                at = end

    return rows.mapInArrow(run, schema)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b: long, not null);
    label is the smallest node that can be reached.

    Alternates the large-star and small-star steps until the set of links is
    stable; each round is two grouped minima and two joins, and is cut from its
    lineage in the shared checkpoint folder. No link is ever collected. Links are
    counted each round; up to FEW_LINKS are one partition, so that the same steps
    need no shuffle and no files for hundreds of empty partitions.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if tuple(now) == before or not now["n"]:
            break
        before = tuple(now)
        if now["n"] <= FEW_LINKS:
            edges = edges.coalesce(1)
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(edges)
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("label")), F.struct(F.col("b").alias("node"), F.col("b").alias("label")))).alias("e")).select("e.*").distinct()
