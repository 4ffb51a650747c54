"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length and source. The share of each source
is filled with whole passes over its documents; what is left of the budget is
fitted over the length counts: a proportional part of every length, then a
bounded knapsack over the rest. The documents of a length are then chosen by a
seeded hash. Only counts per (source, length) reach the fitting; documents stay
distributed and are never gathered by source.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Budget that the knapsack is first run over; see fit().
KNAPSACK = 1 << 16
#: Documents of one source and length that are ranked together.
RANKED = 4096
WORD = r"[^\x20\x09-\x0D]+"


def token_length(column: str = "text") -> Column:
    """Number of words in the text; null counts as empty."""
    return F.coalesce(F.size(F.regexp_extract_all(column, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds s (rank of the source, from 1), weight and target to (source, source_size).

    Sources come by code point, null last, and take the weights in turn. They
    share ``share`` times all tokens by weight; a source stops at ``most`` times
    its own size and its excess goes to the others by weight. In order of
    size over weight the stopped sources come first, so one running sum gives
    the level at which the rest meet. One row per source is all this handles.
    """
    n = len(weights)
    ranked = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("s") - 1, F.lit(n)).cast("int") + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "s")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    meets = F.min(F.when(F.col("most") >= F.col("weight") * F.col("level"), F.struct("place", "level"))).over(everything)
    ranked = ranked.withColumn("place", F.row_number().over(by_room)).withColumn("meets", meets)
    target = F.when(F.col("place") >= F.col("meets.place"), F.col("weight") * F.col("meets.level")).otherwise(F.col("most"))
    return ranked.select("source", "s", "source_size", "weight", F.least(target, F.col("most")).alias("target"))


def _knapsack(lengths: list[int], counts: list[int], budget: int, part: int) -> list[int]:
    """Takes about ``budget - part`` in proportion and fits the rest by a bounded
    knapsack: a bit for each sum that the free documents reach, up to a length
    beyond the budget. With ``part`` no less than the budget nothing is taken
    beforehand and the result is the nearest sum there is."""
    total = sum(a * c for a, c in zip(lengths, counts, strict=True))
    take = [c * max(0, budget - part) // total for c in counts]
    left = budget - sum(a * t for a, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left > part:
            more = min(counts[i] - take[i], (left - part) // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    bits, within, steps = 1, (1 << (left + max(lengths) + 1)) - 1, []
    for i in reversed(order):
        free, lot = counts[i] - take[i], 1
        while free > 0 and not bits >> left & 1:
            lot = min(lot, free)
            grown = (bits | bits << (lot * lengths[i])) & within
            if grown != bits:
                steps.append((i, lot, bits))
                bits = grown
            free, lot = free - lot, lot * 2
    under = (bits & ((1 << (left + 1)) - 1)).bit_length() - 1
    over = bits >> left
    above = left + (over & -over).bit_length() - 1
    reached = above if over and above - left < left - under else under
    for i, lot, without in reversed(steps):
        if not without >> reached & 1:
            take[i] += lot
            reached -= lot * lengths[i]
    return take


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their tokens sum as near to
    ``budget`` as any choice of them can (below it, if two are equally near).

    Lengths are divided by their greatest common divisor, so the nearest multiple
    is the least distance there can be. The knapsack runs over the last part of
    the budget; a part in which that distance isn't reached is made larger, up to
    the whole budget, where the knapsack leaves nothing out. With many lengths the
    first part does; few or rare ones make the budget small or the search long.
    """
    some = [i for i, (a, c) in enumerate(zip(lengths, counts, strict=True)) if a > 0 and c > 0]
    total = sum(lengths[i] * counts[i] for i in some)
    if budget >= total:
        return list(counts)
    unit = math.gcd(*(lengths[i] for i in some))
    goal = budget // unit
    if 2 * (budget - goal * unit) > unit:
        goal += 1
    least, part = abs(budget - goal * unit), KNAPSACK
    small, many = [lengths[i] // unit for i in some], [counts[i] for i in some]
    while True:
        found = _knapsack(small, many, goal, part)
        sum_ = sum(a * t for a, t in zip(small, found, strict=True)) * unit
        if abs(sum_ - budget) <= least or part >= goal:
            break
        part *= 16
    if abs(sum_ - budget) > least and unit > 1:
        # The nearest sum to the goal need not be the nearest to the budget between two multiples.
        other = _knapsack(small, many, 2 * (budget // unit) + 1 - goal, part)
        if abs(sum(a * t for a, t in zip(small, other, strict=True)) * unit - budget) < abs(sum_ - budget):
            found = other
    take = [0] * len(lengths)
    for i, t in zip(some, found, strict=True):
        take[i] = t
    return take


def plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, mark (hash of the text), size,
    source_size, target (of its source), copies (how often the mix takes it).

    A null text has size 0; a null source is a source of its own; an empty table
    gives an empty plan; a source of size 0 has target 0. Repeated rows are
    documents of their own: which of two equal rows is taken makes no difference.
    A rerun on the same rows gives the same plan. Other columns of ``docs``, of
    whatever name, take no part.
    """
    rows = cut(docs.select("doc_id", "source", token_length().alias("size"), F.xxhash64("text").alias("mark")))
    histogram = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = cut(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    placed = histogram.join(sources, histogram["source"].eqNullSafe(sources["source"])).select("s", "size", "n", "source_size", "target")

    def fitted(rows: pa.Table) -> pa.Table:
        lengths, counts = rows["size"].to_pylist(), rows["n"].to_pylist()
        size, target = rows["source_size"][0].as_py(), rows["target"][0].as_py()
        passes = int(target // size) if size else 0
        take = fit(lengths, counts, max(0, round(target - passes * size))) if size else [0] * len(lengths)
        return pa.table({"s": rows["s"], "size": rows["size"], "n": rows["n"], "passes": pa.array([passes] * len(take), pa.int32()), "extra": pa.array(take, pa.int64())})

    counts = placed.groupBy("s").applyInArrow(fitted, "s int, size long, n long, passes int, extra long")
    known = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("doc_id", rows["source"], "mark", "size", "s", "source_size", "target")
    dealt = known.join(counts, ["s", "size"]).withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "mark"), 34))
    dealt = dealt.withColumn("parts", F.ceil(F.col("n") / RANKED)).withColumn("part", F.shiftright(F.col("draw") * F.col("parts"), 30))
    by_part = Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = dealt.where("parts > 1").groupBy("s", "size", "part", "extra").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(by_part), F.lit(0)))
    quota = quota.select("s", "size", "part", F.greatest(F.lit(0), F.col("extra") - F.col("before")).alias("quota"))
    place = F.row_number().over(Window.partitionBy("s", "size", "part").orderBy("draw", "doc_id", "mark"))
    chosen = dealt.join(quota, ["s", "size", "part"], "left").withColumn("place", place)
    copies = F.col("passes") + (F.col("place") <= F.coalesce("quota", "extra")).cast("int")
    return chosen.select("doc_id", "source", "mark", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as the plan takes it; columns stay, those
    with names of this operator's own too."""
    own = Window.partitionBy("doc_id", "source", "mark").orderBy("mark")
    takes = plan(docs, **options).select(F.struct("doc_id", "source", "mark").alias("row"), F.row_number().over(own).alias("nth"), "copies")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(doc, F.struct("doc_id", "source", F.xxhash64("text").alias("mark")).alias("of"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("of.mark")))
    joined = rows.join(takes, F.col("of").eqNullSafe(F.col("row")) & (F.col("place") == F.col("nth"))).where("copies > 0")
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
