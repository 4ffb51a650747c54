import math
import re
from collections import Counter

import numpy as np

from sluice.llm import ordinal
from sluice.llm import queries as Q

MASK, P = (1 << 64) - 1, 0x9E3779B97F4A7C15


def plain_features(text):
    """The features of a text, one word and one byte after the other."""
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)]
    slots = Counter()
    for w in words:
        slots[(sum((b + 1) * pow(P, i, 1 << 64) for i, b in enumerate(w)) * P & MASK) >> (64 - ordinal.BITS)] += 1
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in slots.values())) or 1.0
    out = {c: 10 * math.log1p(n) / norm for c, n in slots.items()}
    marks = [33 <= b < 127 and not chr(b).isalnum() for b in text]
    n, w = max(1, len(text)), max(1, len(words))
    shapes = (
        sum(65 <= b <= 90 for b in text) / n,
        min(1.0, 8 * sum(marks) / n),
        min(1.0, 8 * sum(48 <= b <= 57 for b in text) / n),
        1 - len(set(words)) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        min(1.0, 20 * sum(a and b for a, b in zip(marks, marks[1:])) / n),
    )
    return out | {(1 << ordinal.BITS) + i: 5 * s for i, s in enumerate(shapes)}


def test_query_against_brute_force(spark, tiny, docs):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = ordinal.fit(docs, ordinal.ratings(labels), grades=3)
    got = {r["doc_id"]: r for r in Q.op1_ordinal_quality(spark, tiny).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        score = sum(float(model.weights[c]) * v for c, v in plain_features(text).items())
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(got[d]["expected_grade"] - sum(tails)) < 1e-5 and abs(got[d]["good_probability"] - tails[1]) < 1e-5
        assert got[d]["keep"] == (got[d]["good_probability"] >= ordinal.KEEP_FROM)


def test_fit_reaches_the_minimum(spark, tiny, docs):
    """The loss, written out, is no lower anywhere that plain descent from the fit leads to."""
    grade = {r["doc_id"]: r["grade"] for r in ordinal.ratings(spark.read.parquet(f"{tiny}/labels.parquet")).collect()}
    rows = [(plain_features((r["text"] or "").encode()), grade[r["doc_id"]]) for r in docs.collect() if grade.get(r["doc_id"]) is not None]
    seen = Counter(c for x, _ in rows for c in x)
    active = sorted(c for c, n in seen.items() if n >= min(10, max(1, len(rows) // 10)))
    x = np.array([[f.get(c, 0.0) for c in active] for f, _ in rows])
    y = np.array([g for _, g in rows])
    heavy = np.array([len(y) / len(set(y)) / (y == g).sum() for g in y])

    def loss(w, thresholds):
        below = 1 / (1 + np.exp(-(np.array([-60.0, *thresholds, 60.0])[None, :] - (x @ w)[:, None])))
        below[:, 0], below[:, -1] = 0, 1
        at = np.arange(len(y))
        return float(-(heavy * np.log(np.maximum(below[at, y + 1] - below[at, y], 1e-12))).sum() / len(y) + 1e-4 * w @ w)

    model = ordinal.fit(docs, ordinal.ratings(spark.read.parquet(f"{tiny}/labels.parquet")), grades=3)
    w, thresholds = model.weights[active].astype(float), model.thresholds.astype(float)
    fitted = loss(w, thresholds)
    assert fitted < 0.5 * loss(np.zeros(len(w)), np.array([-0.7, 0.6]))
    rng, least = np.random.default_rng(3), fitted
    for _ in range(300):
        step = rng.normal(size=len(w) + 2) * rng.choice([1e-3, 1e-2, 0.1])
        least = min(least, loss(w + step[:-2], thresholds + step[-2:]), loss(w - step[:-2], thresholds - step[-2:]))
    for i in rng.choice(len(w), 60, replace=False):
        for h in (1e-3, -1e-3, 1e-2, -1e-2):
            moved = w.copy()
            moved[i] += h
            least = min(least, loss(moved, thresholds))
    assert fitted - least < 1e-3


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    w, free = rng.normal(size=12), np.array([-0.4, 0.2, -0.3])
    columns, values = rng.integers(0, 12, 40), rng.normal(size=40)
    starts, grades = np.arange(0, 40, 4), rng.integers(0, 4, 10)
    weigh = np.array([1.0, 2.0, 0.5, 3.0])
    loss, of_w, of_f = ordinal._loss(w, free, columns, values, starts, grades, weigh)
    for i in range(12):
        step = np.zeros(12)
        step[i] = 1e-6
        assert abs((ordinal._loss(w + step, free, columns, values, starts, grades, weigh)[0] - loss) / 1e-6 - of_w[i]) < 1e-3
    for i in range(3):
        step = np.zeros(3)
        step[i] = 1e-6
        assert abs((ordinal._loss(w, free + step, columns, values, starts, grades, weigh)[0] - loss) / 1e-6 - of_f[i]) < 1e-3


def test_words_do_not_depend_on_where_a_long_text_is_cut():
    text = b" ".join(b"word%d" % (i % 500) for i in range(40_000))
    one = {int(ordinal.words_of(b"word%d" % i)[0]) for i in range(500)}
    assert set(ordinal.words_of(text).tolist()) == one and len(ordinal.words_of(text)) == 40_000
    assert int(ordinal.words_of(b"WORD7")[0]) in one


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), ordinal.ratings(labels.where("doc_id % 4 = 0"))
    model = ordinal.fit(docs, ordinal.ratings(train), grades=3)
    assert np.all(np.diff(model.thresholds) > 0)
    rows = ordinal.grade_texts(docs, model).join(held, "doc_id").selectExpr("grade", f"tails[1] >= {ordinal.KEEP_FROM} keep", "expected_grade").collect()
    kept = {g: np.mean([r["keep"] for r in rows if r["grade"] == g]) for g in range(3)}
    assert kept[0] < 0.25 and kept[1] < 0.15 and kept[2] > 0.95
    means = [np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_odd_rows(odd, none, spark):
    ratings = spark.createDataFrame([(1, 2), (3, 2), (6, 0), (7, 0), (8, 1), (None, 1), (9, None), (5, 7)], "doc_id long, grade int")
    model = ordinal.fit(odd, ratings, grades=3, rounds=3)
    rows = ordinal.grade_texts(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["expected_grade"] <= 2 and len(r["tails"]) == 2 for r in rows)
    assert ordinal.select(odd, model, 2, 0.0).columns == odd.columns and ordinal.select(odd, model, 2, 0.0).count() == odd.count()
    empty = ordinal.fit(none, ratings, grades=3)
    assert abs(ordinal.grade_texts(odd, empty).first()["expected_grade"] - 1) < 1e-6
    assert ordinal.grade_texts(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (3, 0, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in ordinal.ratings(labels).collect()} == {1: 0, 2: None, 3: 1, 4: None}
