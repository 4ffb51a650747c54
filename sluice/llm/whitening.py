"""Whitening of embeddings by shifted CholeskyQR.

Vectors are rounded to a grid of integers, so that their sums and deviations are exact.
The distinct ones are the fit list. Its centred rows Y are made orthogonal by passes over
the data: each pass solves the rows against the triangular factors found so far and sums
their Gram matrix, whose Cholesky factor is the next one. The first Gram matrix is shifted,
as is any that is not positive definite to rounding, so that a factor always exists. When
the rows are orthogonal, the composed factor R has R'R = Y'Y, and the singular values of R
give the components without ever squaring their condition.

A pass is one job: a task adds up its own matrix and the matrices are added by entry. What
comes to the driver is one matrix of the dimensions squared; the rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

#: Factors that are tried at most; three do unless dimensions depend on each other.
PASSES = 8
#: Largest entry of a Gram matrix minus the identity that counts as orthogonal.
ORTHOGONAL = 1e-11
#: Standard deviation over the largest one below which a component has no variance: rounding.
NO_VARIANCE = 1e-12
_UNIT = 2.0**-53


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, eigenvalues by falling size and what projects a centred
    row on the components over their standard deviations (no variance: zero)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    project: np.ndarray

    def explained(self) -> np.ndarray:
        return self.values / self.values.sum() if self.values.sum() > 0 else np.full(len(self.values), np.nan)


def on_grid(df: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """``df`` with the column x array<long>, for rows whose vector is neither null nor
    holds null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return df.where(ok).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset).cast("long")))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows) of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def _totals(vectors: DataFrame, each: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """For each length of x the sum of the matrices that ``each`` makes of rows of that
    length; it may give None for a length it doesn't ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, rows in _matrices(batch.column(0)):
                made = each(rows)
                if made is not None:
                    size = rows.shape[1]
                    totals[size] = totals[size] + made if size in totals else made
        for size, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(total))], names=["size", "i", "row"])

    parts = vectors.select("x").mapInArrow(run, f"size int, i int, row array<{kind}>")
    sums = parts.select("size", "i", F.posexplode("row").alias("j", "v")).groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, dict[tuple[int, int], float]] = {}
    for r in sums.collect():
        found.setdefault(r["size"], {})[r["i"], r["j"]] = r["v"]
    whole = {}
    for size, entries in found.items():
        whole[size] = np.zeros([1 + max(k) for k in zip(*entries, strict=True)], dtype=np.int64 if kind == "bigint" else np.float64)
        for (i, j), v in entries.items():
            whole[size][i, j] = v
    return whole


def scaled_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact; an error where that leaves a long."""
    if n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) >= 2.0**62:
        raise OverflowError("n times an entry leaves 64 bits")
    return n * x - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return scaled_deviations(x, n, sums) / n


def solve_rows(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn, column by column."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def next_factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram, or gram plus a small multiple of the identity
    where asked for or needed."""
    size = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * size + size * (size + 1)) * _UNIT * max(float(np.linalg.eigvalsh(gram)[-1]), 0.0)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift = 10 * shift or 1.0


def fit(vectors: DataFrame) -> dict[int, Whitening]:
    """The whitening for each length of the vectors x, which must be distinct."""
    counts = _totals(vectors, lambda x: np.concatenate(([len(x)], x.sum(axis=0)))[None], "bigint")
    known = {size: (int(t[0, 0]), t[0, 1:]) for size, t in counts.items()}
    factors: dict[int, list[np.ndarray]] = {size: [] for size in known}
    grams: dict[int, np.ndarray] = {}
    open_ = set(known)
    while open_:

        def gram(x: np.ndarray, open_=frozenset(open_), factors=factors) -> np.ndarray | None:
            size = x.shape[1]
            if size not in open_:
                return None
            z = solve_rows(centred(x, *known[size]), factors[size])
            return z.T @ z

        for size, g in _totals(vectors, gram, "double").items():
            grams[size] = (g + g.T) / 2
            done = len(factors[size])
            if done == PASSES or done and np.abs(grams[size] - np.eye(size)).max() <= ORTHOGONAL:
                open_.discard(size)
            else:
                factors[size].append(next_factor(grams[size], known[size][0], shifted=not done))
    return {size: _whitening(*known[size], factors[size], grams[size]) for size in known}


def _whitening(n: int, sums: np.ndarray, factors: list[np.ndarray], gram: np.ndarray) -> Whitening:
    # What the last Gram matrix still differs from the identity belongs to R as well; where
    # dimensions depend on each other it has zeros that the factors can't show.
    values, vectors = np.linalg.eigh(gram)
    composed = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for r in reversed(factors):
        composed = composed @ r
    _, deviations, axes = np.linalg.svd(composed)
    real = deviations > NO_VARIANCE * deviations[0]
    scale = np.divide(np.sqrt(n), deviations, out=np.zeros_like(deviations), where=real)
    return Whitening(n, sums, np.where(real, deviations**2 / n, 0.0), axes.T * scale)


def identity_errors(vectors: DataFrame, models: dict[int, Whitening], components: int) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened fit list minus the
    identity, over the components that have variance; nan where none has."""

    def gram(x: np.ndarray) -> np.ndarray:
        m = models[x.shape[1]]
        w = centred(x, m.n, m.sums) @ m.project[:, :components]
        w = np.concatenate((w, np.ones((len(w), 1))), axis=1)
        return w.T @ w

    found = {}
    for size, g in _totals(vectors, gram, "double").items():
        m = models[size]
        real = np.flatnonzero(m.values[:components] > 0)
        mean = g[-1, :-1] / m.n
        covariance = g[:-1, :-1] / m.n - np.outer(mean, mean)
        found[size] = float(np.abs(covariance - np.eye(len(covariance)))[np.ix_(real, real)].max()) if len(real) else np.nan
    return found


def whiten(df: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for
    each row of ``df`` (vec_id, embedding) and component, by falling variance.

    Vectors that are null or hold null or non-finite entries take no part; an empty
    vector has no components and so no row. Vectors of another length are fitted
    apart, with an n of their own. Repeated rows stay repeated and count once in the fit;
    a null vec_id stays null; further columns play no part; an empty table gives an
    empty result. A component without variance (equal vectors, dimensions that
    depend on each other) has a null whitened and explained 0; if none has any,
    explained and identity_error are null. Entries beyond the range of a long on the
    grid, or deviations beyond it, are an error, as they could not be exact.
    """
    vectors = on_grid(df.select("vec_id", "embedding"), "embedding", scale, offset).select("vec_id", "x")
    distinct = cut(vectors.select("x").distinct())
    models = fit(distinct)
    errors = identity_errors(distinct, models, components)

    def each(batch):
        ids = batch["vec_id"]
        for at, x in _matrices(batch["x"]):
            m = models[x.shape[1]]
            k = min(components, x.shape[1])
            scaled = scaled_deviations(x, m.n, m.sums)
            if (scaled.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**63:
                raise OverflowError("a deviation leaves 64 bits")
            whitened = (scaled / m.n) @ m.project[:, :k]
            whitened[:, m.values[:k] == 0] = np.nan
            every = len(x) * k
            numbers = (whitened.ravel(), np.tile(m.explained()[:k], len(x)), np.full(every, errors[x.shape[1]]))
            yield (
                ids.take(pa.array(np.repeat(at, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(every, m.n)),
                pa.array(np.repeat((scaled**2).sum(axis=1), k)),
                *(pa.array(v, mask=np.isnan(v)) for v in numbers),
            )

    return map_rows(vectors, each, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
