"""Exact top-k search by inner product with a pivot table.

Distances from every vector to a fixed number of pivots are computed once. For a
query the largest difference of two pivot distances is a lower bound of the
distance to a vector, and with the norms an upper bound of their inner product.
Vectors are evaluated in the order of that bound until the k-th best score
exceeds the next bound, so nothing that could belong to the result is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, stream_shards

#: Rows of a shard: what one unit of work holds.
SHARD = 4096
_STEP = 128


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<bigint>): floor(scale * component) of each whole vector.
    Vectors that are null or hold null or non-finite components, and rows without
    a vec_id, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x"))


def pivot_table(vectors: DataFrame, pivots: int, seed: int) -> DataFrame:
    """Adds d: the distances to the pivots of the vector's own dimension. The
    pivots are the ``pivots`` vectors of each dimension that come first by a seeded hash."""
    by_draw = Window.partitionBy(F.size("x")).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id")
    chosen = {}
    for row in vectors.withColumn("place", F.row_number().over(by_draw)).where(F.col("place") <= pivots).select("x").collect():
        chosen.setdefault(len(row["x"]), []).append(row["x"])
    chosen = {dim: np.array(rows, dtype=np.float64).reshape(len(rows), dim) for dim, rows in chosen.items()}

    def each(batch):
        far = []
        for x in batch["x"]:
            v = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            far.append(np.sqrt(((chosen[len(v)] - v) ** 2).sum(axis=1)))
        yield batch["vec_id"], batch["x"], far

    return map_rows(vectors, each, "vec_id long, x array<bigint>, d array<double>")


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products. Where one could leave a long they are worked out in integers
    of any size; one that does is an error."""
    if float(np.abs(rows).max(initial=0)) * float(np.abs(query).sum()) < 2.0**62:
        return rows @ query
    out = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in rows]
    if any(abs(v) >= 1 << 63 for v in out):
        raise OverflowError("an inner product does not fit a long")
    return np.array(out, dtype=np.int64)


def best_of(query: np.ndarray, query_far: np.ndarray, rows: np.ndarray, far: np.ndarray, norms: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best of ``rows``, best first, ties to the smaller
    id, and how many rows were evaluated."""
    norm = float((query.astype(np.float64) ** 2).sum())
    low = np.abs(far - query_far).max(axis=1) if far.shape[1] else np.zeros(len(rows))
    high = np.minimum((norm + norms - low**2) / 2, np.sqrt(norm * norms)) + 1e-9 * (norm + norms) + 1e-6
    order = np.argsort(-high, kind="stable")
    got_ids, got = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    seen = 0
    while seen < len(order) and (len(got) < k or got[k - 1] <= high[order[seen]]):
        at = order[seen : seen + _STEP]
        seen += len(at)
        at = at[ids[at] != own]
        got_ids, got = np.concatenate((got_ids, ids[at])), np.concatenate((got, exact(rows[at], query)))
        keep = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[keep], got[keep]
    return got_ids, got, seen


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = 24, scale: int = 256, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score, evaluated): for each vector whose vec_id is
    divisible by ``every``, the k vectors with the highest integer inner product.

    Vectors are compared within their own dimension. Rows with the query's
    vec_id are its own and no candidates. Fewer candidates than k give fewer
    rows; equal query rows count once; an empty table gives an empty result.
    A score beyond a long is an error. Other columns of ``vectors`` take no part.
    """
    table = cut(pivot_table(quantised(vectors, scale), pivots, seed)).withColumn("dim", F.size("x"))
    queries = table.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"])
    shards = max(1, math.ceil(table.count() / SHARD))
    held = table.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "vec_id", "x", "d")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "x", "d")

    def stacked(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).reshape(rows, -1)

    def build(rows: pa.Table):
        x, far = stacked(rows["x"], len(rows)), stacked(rows["d"], len(rows))
        return x, far, (x.astype(np.float64) ** 2).sum(axis=1), rows["vec_id"].to_numpy()

    def answer(shard, rows: pa.Table):
        x, far, norms, ids = shard
        found = [[], [], [], []]
        for own, query, query_far in zip(rows["vec_id"].to_pylist(), stacked(rows["x"], len(rows)), stacked(rows["d"], len(rows)), strict=True):
            got_ids, got, seen = best_of(query, query_far, x, far, norms, ids, own, k)
            for column, values in zip(found, ([own] * len(got), got_ids.tolist(), got.tolist(), [seen] * len(got)), strict=True):
                column.extend(values)
        return found

    found = stream_shards(held, asked, ["dim", "shard"], "vec_id", build, answer, "query_id long, vec_id long, score long, evaluated long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "evaluated")
