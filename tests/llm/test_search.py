import math

import numpy as np
import pytest

from sluice.llm import graph_ann, pivots
from sluice.llm import queries as Q


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)


def test_exact_top_k_equals_brute_force(spark, sf, vectors):
    ids, x = vectors
    z = np.floor(256 * x).astype(np.int64)
    got = {}
    for r in Q.op6_pivot_top_k(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    for q, ranks in got.items():
        scores = z @ z[list(ids).index(q)]
        others = ids != q
        order = np.lexsort((ids[others], -scores[others]))[:5]
        assert [ranks[i + 1] for i in range(5)] == [(int(ids[others][o]), int(scores[others][o])) for o in order]


def test_pivots_stop_early():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (40, 8)) * 8
    rows = (centres[rng.integers(0, 40, 4000)] + rng.integers(-9, 9, (4000, 8))).astype(np.int64)
    chosen = rows[:24].astype(float)
    far = np.sqrt(((rows[:, None, :] - chosen[None]) ** 2).sum(-1))
    norms = (rows.astype(float) ** 2).sum(1)
    q = rows[int(norms.argmax())]
    ids, scores, seen = pivots.best_of(q, np.sqrt(((chosen - q) ** 2).sum(1)), rows, far, norms, np.arange(4000), -1, 5)
    want = np.lexsort((np.arange(4000), -(rows @ q)))[:5]
    assert ids.tolist() == want.tolist() and seen < 4000


def test_graph_recall(spark, sf, vectors):
    ids, x = vectors
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, hit, asked = {}, 0, 0
    for r in Q.op3_robust_graph_ann(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in ids[ids % 50 == 0].tolist():
        i = list(ids).index(q)
        cos = n @ n[i]
        cos[i] = -9
        want = set(ids[np.lexsort((ids, -cos))[:5]].tolist())
        hit, asked = hit + len(want & {v for _, v, _ in got[q]}), asked + 5
        for _, v, s in got[q]:
            j = list(ids).index(v)
            assert abs(s - x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))) < 1e-12
    assert hit / asked >= 0.9


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SHARD", 400)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in graph_ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = sum(len(got[q] & set(np.argsort(-(n @ n[q]))[1:6].tolist())) for q in range(0, 1500, 50))
    assert hit >= 0.9 * 150


ODD = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (100, [1.0, 2.0, 3.0]), (8, [-1.0, 0.25])]


def test_odd_vectors(spark):
    df = spark.createDataFrame([(*r, 1, 1) for r in ODD], "vec_id long, embedding array<float>, dim int, score int")
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in graph_ann.nearest(df).collect()}
    assert near == {(0, 1): 1, (0, 2): 2, (0, 3): 50, (0, 4): 50, (0, 5): 8, (50, 1): 0, (50, 2): 1, (50, 3): 2, (50, 4): 8}
    top = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivots.top_k(df).collect()}
    assert top[(0, 1)] == (1, 65536) and top[(0, 2)] == (2, 65536) and top[(0, 5)] == (3, 0) and top[(50, 1)] == (0, 32768)
    assert graph_ann.nearest(df.where("false")).count() == 0 and pivots.top_k(df.where("false")).count() == 0


def test_many_copies_hide_no_other_id(spark):
    rows = [(0, [3.0, 4.0])] * 6 + [(1, [3.0, 4.0]), (2, [3.0, 4.0])] + [(3, [0.0, 1.0])] * 7
    near = graph_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in near) == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 3)]


def test_clashing_names_and_shards(spark, monkeypatch, vectors):
    monkeypatch.setattr(pivots, "SHARD", 100)
    names = ("dim", "shard", "side", "place", "held", "asked", "x", "d", "v", "block", "own")
    df = spark.createDataFrame([(int(i), v.tolist(), *([1] * len(names))) for i, v in zip(*(a[:700] for a in vectors))], "vec_id long, embedding array<double>, " + ", ".join(f"{n} int" for n in names))
    plain = df.select("vec_id", "embedding")
    want = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivots.top_k(plain).collect()}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivots.top_k(df).collect()} == want and len(want) >= 50
    assert graph_ann.nearest(df).count() == len(want)


def test_large_products_are_exact_or_an_error():
    big = np.array([[1 << 31, 3], [-(1 << 31), 5]])
    assert pivots.exact(big, np.array([1 << 30, 7])).tolist() == [(1 << 61) + 21, -(1 << 61) + 35]
    with pytest.raises(OverflowError):
        pivots.exact(big, np.array([1 << 40, 7]))
