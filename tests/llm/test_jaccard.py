import numpy as np

import corpus_pipeline
from sluice.llm import jaccard, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """doc_id: the smallest doc_id that similar pairs lead to."""
    sets, label = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(texts):
        for b in (x for x in texts if x < a):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if l == high else l for d, l in label.items()}
    return label


def table(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def family(rng, members, words=120):
    base, out = [f"w{x}" for x in rng.integers(0, 10**6, words)], []
    for _ in range(members):
        mine = list(base)
        for at in rng.choice(words, rng.integers(0, 7), replace=False):
            mine[at] = f"z{rng.integers(10**6)}"
        out.append(" ".join(mine))
    return out


def test_every_pair_at_the_bound_is_found(spark, tiny):
    rng = np.random.default_rng(5)
    texts = {}
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
        other = list(words)
        for at in range(20, 121, 25)[:4]:  # 20 of 200 shingles differ: 180 of 220 shared, 0.818
            other[at] = "changed" + str(at)
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(other)
    kept = corpus_pipeline.near_duplicates(spark, table(spark, texts), tiny)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 120, 2))


def test_groups_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = dict(enumerate(t for n in (2, 3, 9, 30) for t in family(rng, n)))
    texts |= {100 + i: t for i, t in enumerate(("", None, "a", "A", "a b c d e", "a b c d e f"))}
    for chunk, pivots in ((1024, 4), (8, 1)):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(table(spark, texts), 0.8).collect()}
        assert got == brute(texts)


def test_failed_nearer_pairs_hide_no_similar_one(spark):
    rng = np.random.default_rng(21)
    for _ in range(3):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
        texts = {}
        for d, changed in ((1, (20, 45)), (2, (70, 95)), (3, (120, 145, 170))):
            texts[d] = " ".join(f"z{d}" if i in changed else w for i, w in enumerate(base))
        assert brute(texts) == {1: 1, 2: 1, 3: 3}
        got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(table(spark, texts), 0.8).collect()}
        assert got == brute(texts)


def test_one_fingerprint_is_not_one_text(spark):
    texts = {d: "again " * 400 + " ".join(f"{x}{d}" for x in "abcdefghij") for d in (1, 2)}
    assert len({simhash.fingerprint(t.encode(), 5) for t in texts.values()}) == 1
    kept = simhash.dedup(table(spark, texts), words=5, min_similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
