"""Places in one order over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.plans.session import cut

#: The rows that come before one in its partition are the low bits of its running id.
_LOW = 33


def place(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 1 in the order, which must leave no ties.

    Rows are dealt out by range and sorted where they are. Only the counts of partitions
    are added up, and what comes before its partition is added to a row's place in it.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", _LOW)
    counts = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offset = F.element_at(F.lit(before or [0]), part.cast("int") + 1)
    return ranged.withColumn(name, offset + F.col("__id").bitwiseAND((1 << _LOW) - 1) + 1).drop("__id")
