import hashlib
import random
from collections import Counter

import numpy as np

from sluice.llm import queries as Q
from sluice.llm import suffix_dedup


def brute(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], cover, [0])).astype(int))).tolist()
        out.append((list(zip(edge[::2], edge[1::2])), bytes(np.frombuffer(b, np.uint8)[~cover])))
    return out


def test_query_against_brute_force(spark, tiny, docs):
    rows = docs.collect()
    want = {r["doc_id"]: (len(r["text"].encode()), *w) for r, w in zip(rows, brute([r["text"].encode() for r in rows], 200))}
    got = Q.op2_suffix_dedup(spark, tiny).collect()
    assert len(got) == len(rows)
    for r in got:
        n, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_small_lengths_and_mutated_copies(spark):
    draw = random.Random(9)
    for length, letters in ((20, "ab"), (33, "abcdefgh"), (48, "ab ")):
        parts = ["".join(draw.choice(letters) for _ in range(draw.randint(5, 90))) for _ in range(12)]
        texts = []
        for _ in range(60):
            t = list("".join(draw.choice(parts) + draw.choice(["", "x", "yz"]) for _ in range(draw.randint(0, 6))))
            for _ in range(draw.randint(0, 3)):
                if t:
                    t[draw.randrange(len(t))] = draw.choice("mnopq")
            texts.append("".join(t))
        texts += ["ab" * 200, "a" * 150, "a" * 150 + "é" * 40]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: ([(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.repeated(df, length).collect()}
        assert got == dict(enumerate(brute([t.encode() for t in texts], length)))


def test_odd_rows(odd, none):
    rows = suffix_dedup.repeated(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_bytes"] == by_id[2]["n_bytes"] == 0 and not by_id[1]["spans"]
    assert len(by_id[3]["kept"]) == 0 == len(by_id[4]["kept"])
    assert [tuple(s) for s in by_id[9]["spans"]] == [(0, by_id[9]["n_bytes"])]
    assert by_id[5]["spans"] == []
    assert suffix_dedup.repeated(none).count() == 0
