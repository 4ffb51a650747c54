import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import ppm
from sluice.llm import queries as Q

K = ppm.ORDER


def symbols(text):
    return ["start"] * K + list((text or "").encode()) + ["end"]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


class Brute:
    def __init__(self, rows):
        self.counts, self.words, self.memo = [defaultdict(Counter) for _ in range(K + 1)], Counter(), {}
        for doc, text in rows:
            if not held(doc):
                s = symbols(text)
                for i in range(K, len(s)):
                    for k in range(K + 1):
                        self.counts[k][tuple(s[i - k : i])][s[i]] += 1
                self.words.update((text or "").encode().lower().split())
                self.words["end"] += 1

    def log(self, context, symbol):
        if (context, symbol) not in self.memo:
            out, value = set(), 0.0
            for k in range(K, -1, -1):
                seen = self.counts[k].get(context[K - k :])
                if seen:
                    left = {s: n for s, n in seen.items() if s not in out}
                    total = sum(left.values()) + len(left)
                    if symbol in left:
                        value += math.log10(left[symbol] / total)
                        break
                    if left:
                        value += math.log10(len(left) / total)
                    out |= set(seen)
            else:
                value -= math.log10(257 - len(out))
            self.memo[context, symbol] = value
        return self.memo[context, symbol]

    def score(self, text):
        s = symbols(text)
        return sum(self.log(tuple(s[i - K : i]), s[i]) for i in range(K, len(s)))

    def base(self, text):
        total = sum(self.words.values()) + len(self.words) + 1
        return sum(math.log10((self.words.get(w, 0) + 1) / total) for w in [*(text or "").encode().lower().split(), "end"])


def compare(rows, got):
    model = Brute([(r["doc_id"], r["text"]) for r in rows])
    want = sorted((repr(r["doc_id"]), round(model.score(r["text"]), 5), round(model.base(r["text"]), 5), len((r["text"] or "").split()) and len((r["text"] or "").encode().split())) for r in rows)
    have = sorted((repr(r["doc_id"]), round(r["score"], 5), round(r["base_score"], 5), r["n_tokens"] - 1) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[0] == b[0] and a[3] == b[3] and a[1] == pytest.approx(b[1], rel=1e-6, abs=1e-4) and a[2] == pytest.approx(b[2], rel=1e-6, abs=1e-4)
    assert all(r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == sum(model.words.values()) for r in got)
    return model


def test_query_against_brute_force(spark, tiny, docs):
    rows = docs.collect()
    model = compare(rows, Q.op8_ppm_scoring(spark, tiny).collect())
    context = next(iter(model.counts[K]))
    assert abs(sum(10 ** model.log(context, s) for s in [*range(256), "end"]) - 1) < 1e-9


def test_blocks_agree_with_one(spark, docs, monkeypatch):
    few = docs.where("doc_id < 40")
    one = {r["doc_id"]: r["score"] for r in ppm.score(few).collect()}
    monkeypatch.setattr(ppm, "BLOCK", 20_000)
    monkeypatch.setattr(ppm, "_PIECE", 3_000)
    many = {r["doc_id"]: r["score"] for r in ppm.score(few).collect()}
    assert many == pytest.approx(one)


def test_odd_rows(odd, none):
    compare(odd.collect(), ppm.score(odd).collect())
    assert ppm.score(none).count() == 0
    apart = odd.where("doc_id = 2").select("doc_id", "text")
    from pyspark.sql import functions as F

    assert ppm.score(apart, F.lit(True)).first()["score"] == pytest.approx(-math.log10(257))


def test_counts_of_words_are_exact():
    n = (1 << 24) + 1
    near = float(np.float32(n))
    key = int(ppm._word_keys([b"often"])[0])
    docs = pa.table({"doc_id": [1], "held_out": [False], "text": [b"often often"]})
    texts = ppm.keys_of_block(pa.table({"block": pa.array([0], pa.int32()), "text": [b"often often"]}))
    entries = [(k, -1.0) for k in texts["key"].to_pylist() if k >= 0 and k != ppm.STOP] + [(key, near), (key, n - near), (ppm.STOP, 2.0)]
    got = ppm.score_block(docs, pa.table({"key": pa.array([k for k, _ in entries], pa.int64()), "value": pa.array([v for _, v in entries], pa.float32())}))
    assert got["words"][0].as_py() == pytest.approx(2 * math.log10(n + 1) + math.log10(3), rel=1e-15)


def test_lengths_of_grams_in_and_out_of_training(spark):
    rows = [(1, "abcabcabd abcabe"), (3, "zabcab"), (4, ""), (5, "é")]
    model = Brute(rows)
    keys, counts = ppm._tallied([t.encode() for d, t in rows if not held(d)])
    seen = spark.createDataFrame(list(zip(keys.tolist(), counts.tolist())), "key long not null, n long not null")
    asked = {}
    for text in ("abcabd", "zabx", "qqq", "cabe abcab", "é"):
        s = symbols(text)
        asked |= dict(zip(ppm.grams([text.encode()])[0].tolist(), [model.log(tuple(s[i - K : i]), s[i]) for i in range(K, len(s))]))
    told = {r["key"]: r["value"] for r in ppm.seen_lengths(seen).collect()}
    rest = spark.createDataFrame([(k,) for k in asked if k not in told], "key long not null")
    found = {r["key"]: r["value"] for r in ppm.unseen_lengths(seen, rest).collect()}
    assert set(found) == set(asked) - set(told) and len(found) < len(asked)
    assert {k: {**told, **found}[k] for k in asked} == pytest.approx(asked)


def test_tables_of_counts_are_exchanged_once(spark, docs):
    context, most = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(most)
    spark.conf.set(most, "-1")
    try:
        before = context.newShuffleId()
        ppm.score(docs.where("doc_id < 10")).collect()
        found = context.newShuffleId() - before - 1
        assert found <= 28, found
    finally:
        spark.conf.set(most, usual)


def test_words_that_were_forgotten_are_found_again(monkeypatch):
    rows = [b"one two three two", b"four one five", b"three six"]
    table = pa.table({"block": pa.array([0] * 3, pa.int32()), "text": rows})
    whole = ppm.keys_of_block(table)["key"].to_pylist()
    entries = pa.table({"key": pa.array(whole, pa.int64()), "value": pa.array([-1.0 if 0 <= k < ppm.STOP else float(k % 7) for k in whole], pa.float32())})
    docs = pa.table({"doc_id": [1, 2, 3], "held_out": [False] * 3, "text": rows})
    want = ppm.score_block(docs, entries)
    monkeypatch.setattr(ppm, "WORDS", 2)
    monkeypatch.setattr(ppm, "_PIECE", 5)
    assert sorted(ppm.keys_of_block(table)["key"].to_pylist()) == sorted(whole) and ppm.score_block(docs, entries) == want
