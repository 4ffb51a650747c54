import numpy as np
import pytest

from sluice.llm import queries as Q
from sluice.llm import whitening


def brute(rows, components=16):
    """(vec_id, component): (n, deviation, |whitened|, explained), by an eigendecomposition."""
    rows = [(i, np.floor(np.array(v, dtype=np.float64) * 64).astype(np.int64) + 1_000_000) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in rows:
        deviation = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums, strict=True))
        w = ((n * x - sums) / n) @ axes / np.sqrt(np.maximum(values, 1e-300))
        for c in range(min(components, len(x))):
            out[i, c + 1] = (n, deviation, w[c], values[c] / values.sum())
    return out


def check(rows, want):
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(want)
    signs = {}
    for key, (n, deviation, w, explained) in want.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-10 and abs(r["whitened"]) == pytest.approx(abs(w), abs=1e-7)
        if abs(w) > 1e-3:
            assert signs.setdefault(key[1], np.sign(w) * np.sign(r["whitened"])) == np.sign(w) * np.sign(r["whitened"])


def test_query_against_eigenvectors(spark, tiny):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    check(Q.op12_embedding_whitening(spark, tiny).collect(), brute(rows))


def test_badly_conditioned_vectors(spark):
    """Deviations from 10,000 down to 1 on the grid, over a mean a hundred times as large."""
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    v = rng.normal(size=(800, 6)) * np.array([1e4, 1e3, 300, 30, 3, 1]) @ turn / 64 + 1e4
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), brute(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 4)).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(3, v[3]), (None, v[0]), (50, None), (51, [1.0, None, 2.0, 3.0]), (52, [1.0, float("nan"), 2.0, 3.0]), (53, [1.0, float("inf"), 2.0, 3.0]), (54, [])]
    df = spark.createDataFrame([(*r, 7, 8.0) for r in rows], "vec_id long, embedding array<float>, n int, x double")
    got = whitening.whiten(df).collect()
    want = brute([(i, np.float32(x).tolist()) for i, x in enumerate(v)])
    check([r for r in got if r["vec_id"] not in (3, None)], {k: w for k, w in want.items() if k[0] != 3})
    assert len([r for r in got if r["vec_id"] == 3]) == 8 and len([r for r in got if r["vec_id"] is None]) == 4 and len(got) == 168
    assert whitening.whiten(df.where("false")).count() == 0


def test_no_variance_and_other_lengths(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(20, [1.0, 2.0]), (21, [1.0, 2.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 9 * 3 + 2 * 2
    assert got[0, 1]["whitened"] is not None and got[0, 1]["explained"] == pytest.approx(1) and got[0, 1]["identity_error"] < 1e-10
    assert got[0, 2]["whitened"] is None and got[0, 2]["explained"] == 0 and got[0, 1]["n"] == 9
    alone = got[20, 1]
    assert (alone["n"], alone["deviation"], alone["whitened"], alone["explained"], alone["identity_error"]) == (1, 0, None, None, None)


def test_deviations_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(df).collect()


def test_factors():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(5, 5))) + 4 * np.eye(5)
    rows = rng.normal(size=(20, 5))
    assert np.allclose(whitening.solve_rows(rows @ r, [r]), rows)
    assert np.allclose(whitening.next_factor(np.zeros((3, 3)), 5, True), np.eye(3))
