import math
from collections import Counter

import pytest

import corpus_pipeline
from sluice.llm import ordinal
from tests.llm.test_line_dedup import brute as removed_lines
from tests.llm.test_mixing import shares


@pytest.fixture(scope="module")
def stages(spark, tiny, docs):
    out, now = [docs.collect()], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, tiny)
        rows = now.collect()
        out.append(rows)
        if name != "encode":
            assert now.columns == docs.columns
            now = spark.createDataFrame(rows, docs.schema)
    return out


def test_quality_keeps_clean_documents(spark, tiny, stages):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    clean = [d for d, l in labels.items() if l == (1, 0)]
    bad = [d for d, l in labels.items() if l != (1, 0)]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean) and not [d for d in bad if d in kept]
    assert ordinal.KEEP_FROM < 0.5


def test_lines_follow_the_brute_force(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1]}
    gone = removed_lines(list(before.items()))
    want = {}
    for d, text in before.items():
        left = "\n".join(l for i, l in enumerate(text.split("\n")) if i not in set(gone.get(d, [])))
        if not gone.get(d) or left.strip():
            want[d] = left
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_duplicates_leave_one_of_each_group(stages):
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[2]}
    kept = {r["doc_id"] for r in stages[3]}
    for gone in set(sets) - kept:
        assert any(len(sets[gone] & s) >= 0.8 * len(sets[gone] | s) for d, s in sets.items() if d != gone)
    ids = sorted(kept)
    left = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not left


def test_mix_comes_as_near_as_documents_allow(stages):
    sizes, taken = {}, Counter()
    for r in stages[3]:
        sizes.setdefault(r["source"], []).append(len(r["text"].encode().split()))
    for r in stages[4]:
        taken[r["source"]] += len(r["text"].encode().split())
    want = shares({s: sum(v) for s, v in sizes.items()})
    for s, mine in sizes.items():
        passes = int(want[s] // sum(mine))
        sums = {0}
        for n in mine:
            sums |= {t + n for t in sums}
        nearest = min(abs(want[s] - passes * sum(mine) - t) for t in sums)
        assert abs(taken[s] - want[s]) <= nearest + 1
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2


def test_encoding_covers_the_mix(stages):
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    assert all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in stages[5])


def test_run_is_the_same(spark, tiny, stages):
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, tiny).collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in stages[5])
    assert math.isfinite(len(stages[5]))
