import numpy as np
import pytest
import xxhash

from sluice.llm import common
from sluice.llm import queries as Q
from sluice.llm import simhash


def brute(text, k):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(q, 42) for q in s]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)) if hs else 0


def components(prints):
    ids = sorted(prints)
    v = np.array([prints[i] for i in ids], dtype=np.uint64)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in np.nonzero(np.bitwise_count(v ^ v[k]) <= 3)[0]:
            a, b = find(i), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, tiny, docs):
    got = {r["doc_id"]: r for r in Q.op9_simhash_near_dedup(spark, tiny).collect()}
    prints = {r["doc_id"]: brute(r["text"], 3) for r in docs.collect()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == components(prints)


def test_large_bucket_is_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = {i: base ^ (1 << int(rng.integers(40))) ^ (1 << int(rng.integers(40))) for i in range(60)}
    prints |= {100 + i: int(rng.integers(1 << 62)) for i in range(40)}
    df = spark.createDataFrame([(v,) for v in prints.values()], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.close_links(df, 3, 6, 3).collect()]
    want = components(prints)
    parent = {v: v for v in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        parent[find(a)] = find(b)
    ids = sorted(prints)
    assert all((find(prints[i]) == find(prints[j])) == (want[i] == want[j]) for i in ids for j in ids)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_distances_over_all_bits():
    """Families within a few bits of each other, at any place of the 64, in groups of three and more."""
    rng = np.random.default_rng(11)
    for _ in range(2000):
        base = int(rng.integers(1 << 63)) << 1 | int(rng.integers(2))
        family = {base}
        for _ in range(int(rng.integers(2, 8))):
            at = rng.choice(64, int(rng.integers(1, 7)), replace=False).tolist() + [63] * int(rng.integers(2))
            family.add(base ^ sum({1 << int(x) for x in at}))
        ids = dict(enumerate(sorted(family)))
        want = components(ids)
        links = simhash.nearest_forest(np.array([signed(v) for v in ids.values()], dtype=np.int64), 3)
        label = {signed(v): signed(v) for v in family}
        for a, b, far in links:
            assert far == ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
            low, high = sorted((label[a], label[b]))
            label = {v: low if x == high else x for v, x in label.items()}
        for i in ids:
            for j in ids:
                assert (want[i] == want[j]) == (label[signed(ids[i])] == label[signed(ids[j])])


def test_links_over_all_bits(spark):
    rng = np.random.default_rng(12)
    prints = {}
    for _ in range(40):
        base = int(rng.integers(1 << 63)) << 1 | int(rng.integers(2))
        prints[len(prints)] = base
        for _ in range(6):
            at = rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist()
            prints[len(prints)] = base ^ sum(1 << int(x) for x in at)
        prints[len(prints)] = base ^ 1 << 63
    links = simhash.close_links(spark.createDataFrame([(signed(v),) for v in prints.values()], "fp long"), 3, 6, 3).collect()
    label = {signed(v): signed(v) for v in prints.values()}
    for r in links:
        assert r["bits"] == ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3
        low, high = sorted((label[r["a"]], label[r["b"]]))
        label = {v: low if x == high else x for v, x in label.items()}
    want = components(prints)
    assert all((want[i] == want[j]) == (label[signed(prints[i])] == label[signed(prints[j])]) for i in prints for j in prints)


def test_odd_rows(odd, none):
    rows = simhash.groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[7] == 1 and by_id[3] == by_id[4] == 3 and by_id[5] == 5
    assert simhash.groups(none).count() == 0
    kept = simhash.dedup(odd, words=5, max_bits=14, blocks=9, pick=3, min_similarity=0.8)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 5, 6, 8, 9]


def test_similarity_is_verified(spark):
    words = [f"q{i}" for i in range(300)]
    near, far = list(words), list(words)
    near[150] = "changed"
    far[::6] = [f"z{i}" for i in range(50)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    found = simhash.dedup(df, words=5, max_bits=14, blocks=9, pick=3, min_similarity=0.8)
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]


def test_texts_with_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (2, b), (None, a), (None, "c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 rid", "8 label")
    for options in ({}, {"min_similarity": 0.8, "words": 5}):
        kept = simhash.dedup(df, **options)
        assert kept.columns == df.columns
        assert sorted((str(r["doc_id"]), r["text"], r["rid"]) for r in kept.collect()) == sorted([("1", a, 9), ("1", b, 9), ("None", "c d", 9)])


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_shuffled_or_in_one_partition(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (200, 201), (200, 201)]
    found = common.connected_components(spark.createDataFrame(links, "a long, b long"))
    want = {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98, 200: 200, 201: 200}
    rows = found.collect()
    assert {r.node: r.label for r in rows} == want and len(rows) == len(want)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
