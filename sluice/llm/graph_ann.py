"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt into shards; each shard holds a graph whose edges come from
greedy searches of the graph so far, thinned by relaxed pruning: a candidate is
dropped if an edge already kept is closer to it than the point itself by the
factor ``alpha``. A query runs a beam search in every shard and the shards'
answers are merged. Everything inside a shard works on many points at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stream_shards

#: Distinct vectors of a shard: what one unit of work holds.
SHARD = 4096
_LOT = 512
_EXPAND = 4
_FAR = np.float32(9.0)


def _beam_search(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the beam of each asked vector after a greedy search.
    x holds unit vectors; the distance is 2 - 2 * cosine; -1 fills short beams."""
    n, lot = len(x), len(asked)
    rows = np.arange(lot)[:, None]
    seen = np.zeros((lot, n), dtype=bool)
    seen[:, entry] = True
    ids = np.full((lot, width), -1, dtype=np.int32)
    far = np.full((lot, width), _FAR, dtype=np.float32)
    done = np.ones((lot, width), dtype=bool)
    at = entry[:width]
    ids[:, : len(at)], far[:, : len(at)], done[:, : len(at)] = at, 2 - 2 * (asked @ x[at].T), False
    while True:
        waiting = np.where(done, _FAR + 1, far)
        nearest = np.argpartition(waiting, min(_EXPAND, width - 1), axis=1)[:, :_EXPAND]
        open_ = ~done[rows, nearest]
        if not open_.any():
            return ids, far
        done[rows, nearest] = True
        new = np.where(open_[:, :, None], edges[ids[rows, nearest]], -1).reshape(lot, -1)
        new.sort(axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        fresh &= ~seen[rows, new]
        who, col = np.nonzero(fresh)
        if not len(who):
            continue
        what = new[who, col]
        seen[who, what] = True
        new_far = np.full(new.shape, _FAR, dtype=np.float32)
        new_far[who, col] = 2 - 2 * np.einsum("ij,ij->i", asked[who], x[what])
        new[~fresh] = -1
        all_ids, all_far = np.concatenate((ids, new), axis=1), np.concatenate((far, new_far), axis=1)
        all_done = np.concatenate((done, ~fresh), axis=1)
        keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        ids, far, done = all_ids[rows, keep], all_far[rows, keep], all_done[rows, keep]


def _prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Relaxed pruning: up to ``degree`` edges for each point out of its row of
    candidates (-1 for none), nearest first."""
    candidates = np.sort(candidates, axis=1)
    good = (candidates >= 0) & (candidates != points[:, None])
    good[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    at = x[candidates]
    far = np.where(good, 2 - 2 * np.einsum("bcd,bd->bc", at, x[points]), _FAR)
    kept = np.full((len(points), degree), -1, dtype=np.int32)
    rows = np.arange(len(points))
    for j in range(degree):
        best = far.argmin(axis=1)
        some = far[rows, best] < _FAR
        if not some.any():
            break
        kept[some, j] = candidates[rows, best][some]
        between = 2 - 2 * np.einsum("bcd,bd->bc", at, at[rows, best])
        far = np.where(alpha * between <= far, _FAR, far)
        far[rows, best] = _FAR
    return kept


def build(x: np.ndarray, degree: int, width: int, alpha: float, seed: int) -> np.ndarray:
    """Edges (n by degree, -1 for none) of the graph over the unit vectors x."""
    n = len(x)
    draw = np.random.default_rng(seed)
    edges = np.full((n, degree), -1, dtype=np.int32)
    if n < 2:
        return edges
    start = min(degree // 2, n - 1)
    edges[:, :start] = (np.arange(n)[:, None] + draw.integers(1, n, (n, start))) % n
    entry = entries(x)
    for _ in range(2):
        order = draw.permutation(n)
        for lot in range(0, n, _LOT):
            points = order[lot : lot + _LOT]
            found, _far = _beam_search(x, edges, entry, x[points], width)
            edges[points] = _prune(x, points, np.concatenate((found, edges[points]), axis=1), degree, alpha)
            source, target = np.repeat(points, degree), edges[points].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.lexsort((-(x[source] * x[target]).sum(axis=1), target))
            source, target = source[by], target[by]
            first = np.concatenate(([True], target[1:] != target[:-1])) if len(target) else np.empty(0, bool)
            place = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
            near = place < degree
            told = target[first]
            back = np.full((len(told), degree), -1, dtype=np.int32)
            back[(np.cumsum(first) - 1)[near], place[near]] = source[near]
            for part in range(0, len(told), _LOT):
                some = told[part : part + _LOT]
                edges[some] = _prune(x, some, np.concatenate((edges[some], back[part : part + _LOT]), axis=1), degree, alpha)
    return edges


def entries(x: np.ndarray, count: int = 8) -> np.ndarray:
    """Where searches start: the vector nearest to the mean and some spread over the shard."""
    middle = int((x @ x.mean(axis=0)).argmax())
    return np.unique(np.concatenate(([middle], np.linspace(0, len(x) - 1, min(count, len(x))).astype(int))))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim): rows whose vector is whole, finite and not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("dim"))


def index(vectors: DataFrame, k: int, degree: int = 24, width: int = 48, alpha: float = 1.2, seed: int = 11) -> DataFrame:
    """(dim, shard, place, v, vec_ids, edges): the graph of every shard, one row per
    distinct vector; edges hold places of the same shard.

    Equal vectors are one node. vec_ids holds its k + 1 smallest ids, each as often
    as it occurs and k times at most: in ties the smaller id wins, so a later copy
    can be in no result of k.
    """
    ids = usable(vectors).groupBy("v", "dim", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ids = ids.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], x["n"])))
    nodes = cut(ids.groupBy("v", "dim").agg(each.alias("vec_ids")))
    shards = max(1, math.ceil(nodes.count() / SHARD))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first").reset_index(drop=True)
        x = np.stack(rows["v"].to_list())
        edges = build((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), degree, width, alpha, seed)
        return pd.DataFrame({"dim": rows["dim"], "shard": rows["shard"], "place": np.arange(len(rows), dtype=np.int32), "v": rows["v"], "vec_ids": rows["vec_ids"], "edges": list(edges)})

    dealt = nodes.withColumns({"shard": F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"), "first": F.col("vec_ids")[0]})
    return cut(dealt.groupBy("dim", "shard").applyInPandas(one, "dim int, shard int, place int, v array<double>, vec_ids array<bigint>, edges array<int>"))


def search(graph: DataFrame, queries: DataFrame, k: int, width: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine for each row
    (vec_id, v, dim) of ``queries``; score is the cosine in double precision."""
    shards = graph.select(F.col("dim").alias("of"), "shard").distinct()
    asked = queries.join(shards, F.col("dim") == F.col("of")).select("dim", "shard", "vec_id", "v")

    def stacked(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).reshape(rows, -1)

    def opened(rows: pa.Table):
        exact, edges = stacked(rows["v"], len(rows)), stacked(rows["edges"], len(rows))
        norms = np.linalg.norm(exact, axis=1)
        x = (exact / norms[:, None]).astype(np.float32)
        return exact, norms, x, edges, entries(x), rows["vec_ids"].to_pylist()

    def answer(shard, rows: pa.Table):
        exact, norms, x, edges, entry, ids = shard
        found = [[], [], []]
        for lot in range(0, len(rows), _LOT):
            some = rows.slice(lot, _LOT)
            q = stacked(some["v"], len(some))
            q_norms = np.linalg.norm(q, axis=1)
            beams, _far = _beam_search(x, edges, entry, (q / q_norms[:, None]).astype(np.float32), width)
            for own, v, norm, beam in zip(some["vec_id"].to_pylist(), q, q_norms, beams, strict=True):
                beam = beam[beam >= 0]
                scores = (exact[beam] * v).sum(axis=1) / (norms[beam] * norm)
                named = sorted((-s, i) for s, b in zip(scores.tolist(), beam.tolist(), strict=True) for i in ids[b] if i != own)[:k]
                for column, values in zip(found, ([own] * len(named), [i for _, i in named], [-s for s, _ in named]), strict=True):
                    column.extend(values)
        return found

    found = stream_shards(graph.select("dim", "shard", "place", "v", "vec_ids", "edges"), asked, ["dim", "shard"], "place", opened, answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each vector whose
    vec_id is divisible by ``every``, among all other vectors of its dimension.

    Vectors that are null, zero or hold null or non-finite components take no
    part; neither do rows without a vec_id. Rows with the query's vec_id are its
    own. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    queries = usable(vectors).where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    return search(index(vectors, k, **options), queries, k)
