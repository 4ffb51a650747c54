import random

from pyspark.sql import functions as F

from sluice.llm import mixing
from sluice.llm import queries as Q


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_query_follows_the_contract(spark, sf):
    rows = Q.op4_subset_sum_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {d: len((r["text"] or "").encode().split()) for d, r in docs.items()}
    total = {}
    for d, r in docs.items():
        total[r["source"]] = total.get(r["source"], 0) + size[d]
    want, taken = shares(total), {}
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s]
        assert abs(r["target"] - want[s]) < 1e-6 * want[s]
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 3 for s in want)
    again = {r["doc_id"]: r["taken"] for r in Q.op4_subset_sum_mixing(spark, sf).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def reachable(lengths, counts):
    sums = {0}
    for a, c in zip(lengths, counts):
        sums = {s + a * t for s in sums for t in range(c + 1)}
    return sums


def test_fit_reaches_the_nearest_sum(monkeypatch):
    draw = random.Random(6)
    for case in range(600):
        monkeypatch.setattr(mixing, "KNAPSACK", draw.choice([1, 40, 1 << 16]))
        unit, top = draw.choice([1, 1, 2, 7, 30]), draw.choice([9, 300, 60_000])
        lengths = [0] * draw.randint(0, 1) + [unit * a for a in draw.sample(range(1, top), draw.randint(1, 4))]
        counts = [draw.randint(0, 4) for _ in lengths]
        sums = reachable(lengths, counts)
        budget = draw.randint(0, max(sums) + 3)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts))
        assert abs(budget - sum(a * t for a, t in zip(lengths, take))) == min(abs(budget - s) for s in sums), (lengths, counts, budget)
    assert sum(a * t for a, t in zip((70_001, 90_001), mixing.fit([70_001, 90_001], [3, 3], 200_000))) == 210_003


def test_hot_length_is_dealt_by_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 8)
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(101)] + [(1000 + i, "a b c d", "t") for i in range(200)], "doc_id long, text string, source string")
    rows = mixing.plan(df, weights=(1, 3), share=1.0, most=2.0).collect()
    for s in "st":
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 4


def test_odd_rows(odd, none):
    rows = mixing.plan(odd).collect()
    assert len(rows) == odd.count() and all(r["size"] * r["copies"] <= 2 * r["size"] for r in rows)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(odd.withColumns({"doc": F.lit("x"), "row": F.lit(2), "nth": F.lit(0), "place": F.lit(0)}).select(*odd.columns, "doc", "row", "nth", "place"))
    assert mixed.columns[-4:] == ["doc", "row", "nth", "place"]
    mixed = mixed.select(*odd.columns)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rows)
