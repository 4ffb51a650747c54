"""Quality classifier: ordinal cumulative-link regression on hashed text.

One weight vector is shared by all grades; ordered thresholds cut its score:
P(grade <= j) = sigmoid(threshold_j - w.x). A text gets its expected grade and
the tail probability of reaching the grade asked for, which selects documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, cut, map_rows, text_bytes

#: Hashed features: words without case and outer punctuation, and shape features.
BITS = 20
_SHAPES = 6
#: Tail probability of the top grade from which a document is kept: grades weigh
#: the same in the sample, so clean documents of a rare kind stand below one half.
KEEP_FROM = 0.25
#: Tasks that sum gradients in a round of fitting.
TASKS = 8
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_PRIME, 1 << 16), _powers(_INVERSE, 1 << 16)


def _piece_words(raw: np.ndarray) -> np.ndarray:
    """Hash of each run of word bytes in at most 2^16 bytes, without case."""
    is_word = _WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], dtype=np.uint64)))
        return (sums[ends] - sums[starts]) * _DOWN[starts]


def words_of(text: bytes) -> np.ndarray:
    """Hash of each word of the whole text; pieces are cut between words."""
    raw, out, at = np.frombuffer(text, dtype=np.uint8), [], 0
    while at < len(raw):
        end = min(len(raw), at + len(_UP))
        if end < len(raw):
            gaps = np.flatnonzero(~_WORD_BYTE[raw[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        out.append(_piece_words(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text, all of it. Hashed words count log(1 + count) on
    a common scale for long and short texts; shapes are shares of kinds of bytes,
    of repeated words and of words whose neighbour is the same."""
    words = words_of(text)
    raw = np.frombuffer(text, dtype=np.uint8)
    with np.errstate(over="ignore"):
        slots = ((words * _PRIME) >> np.uint64(64 - bits)).astype(np.int64)
    columns, counts = np.unique(slots, return_counts=True)
    values = np.log1p(counts)
    norm = math.sqrt(float((values**2).sum())) or 1.0
    n, w = max(1, len(raw)), max(1, len(words))
    marks = ((raw >= 33) & (raw < 48)) | ((raw >= 58) & (raw < 65)) | ((raw >= 91) & (raw < 97)) | ((raw >= 123) & (raw < 127))
    shape = [
        float(((raw >= 65) & (raw <= 90)).sum()) / n,
        min(1.0, 8 * float(marks.sum()) / n),
        min(1.0, 8 * float(((raw >= 48) & (raw <= 57)).sum()) / n),
        1.0 - len(np.unique(words)) / w,
        float((words[1:] == words[:-1]).sum()) / w,
        min(1.0, 20 * float((marks[1:] & marks[:-1]).sum()) / n),
    ]
    return np.concatenate((columns, (1 << bits) + np.arange(_SHAPES))), np.concatenate((values * (10 / norm), 5 * np.array(shape)))


@dataclass(frozen=True)
class Model:
    """weights: one per feature; thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, text: bytes) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        columns, values = features(text, self.bits)
        score = float((self.weights[columns] * values).sum())
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def _ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds out of free parameters: the first, then logarithms of the steps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def _loss(weights: np.ndarray, free: np.ndarray, columns: np.ndarray, values: np.ndarray, starts: np.ndarray, grades: np.ndarray, weigh: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed negative log likelihood of rows and its gradients; a row of grade g
    weighs weigh[g]. Row i has the columns and values from starts[i] on; no row is
    without any."""
    thresholds = _ordered(free)
    wide = np.concatenate(([-60.0], thresholds, [60.0]))
    scores = np.add.reduceat(weights[columns] * values, starts)
    edge = 1 / (1 + np.exp(-np.clip(wide[None, :] - scores[:, None], -60, 60)))
    edge[:, 0], edge[:, -1] = 0.0, 1.0
    rows = np.arange(len(grades))
    high, low = edge[rows, grades + 1], edge[rows, grades]
    p = np.maximum(high - low, 1e-12)
    heavy = weigh[grades]
    d_high, d_low = heavy * high * (1 - high) / p, heavy * low * (1 - low) / p
    of_weights = np.bincount(columns, weights=values * np.repeat(d_high - d_low, np.diff(np.append(starts, len(columns)))), minlength=len(weights))
    of_thresholds = np.bincount(np.concatenate((grades + 1, grades)), weights=np.concatenate((-d_high, d_low)), minlength=len(wide))[1:-1]
    steps = np.concatenate(([1.0], np.exp(free[1:])))
    return float(-(heavy * np.log(p)).sum()), of_weights, np.cumsum(of_thresholds[::-1])[::-1] * steps


def _descend(loss, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; loss gives value and gradient."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, used = slope.copy(), []
        for s, y in reversed(moves):
            used.append(float(s @ way / (y @ s)))
            way -= used[-1] * y
        way *= float(moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])) if moves else 1 / max(1.0, float(np.abs(slope).sum()))
        for (s, y), a in zip(moves, reversed(used), strict=True):
            way += s * (a - float(y @ way / (y @ s)))
        step = 1.0
        while True:
            to = x - step * way
            new_value, new_slope = loss(to)
            if new_value <= value - 1e-4 * step * float(slope @ way) or step < 1e-5:
                break
            step /= 3
        if (to - x) @ (new_slope - slope) > 1e-12:
            moves = [*moves, (to - x, new_slope - slope)][-memory:]
        gained, x, value, slope = value - new_value, to, new_value, new_slope
        if gained < 1e-5 * abs(value):
            break
    return x


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = 15_000, rounds: int = 50, ridge: float = 2e-4, seen: int = 10, bits: int = BITS, seed: int = 5) -> Model:
    """Fits the model to documents with ratings (doc_id, grade 0 .. grades - 1).

    At most ``sample`` ratings are used, drawn by a seeded hash of the doc_id so
    that a rerun draws the same; each grade has the same share as far as it has
    rows, and grades weigh the same in all. This bound is
    what fitting costs at any size, and it bounds what is broadcast to find the
    texts. Ratings without a grade or with one out of range are left out.
    Features of fewer than ``seen`` rows of the sample keep weight 0. Every round
    is one Spark job over the features of the sample: tasks sum the gradients of
    their rows. No usable rows give a model that finds all grades equally likely.
    """
    by_draw = Window.partitionBy("grade").orderBy(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__doc"), 11), "__doc")
    rated = ratings.where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__doc"), F.col("grade").cast("int").alias("grade"))
    # A little more than the share of each grade by its draw, so that few rows are ranked.
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for grade, n in counts.items():
        share = F.when(F.col("grade") == grade, F.lit(1.2 * sample / grades / n + 100 / n)).otherwise(share)
    rated = rated.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__doc"), 11) / F.lit(float(1 << 53)) < share)
    chosen = rated.select("grade", "__doc", F.row_number().over(by_draw).alias("place")).where(F.col("place") <= sample // grades)
    usable = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc")).select("text", "grade")
    weights = np.zeros((1 << bits) + _SHAPES)

    def described(batch):
        rows = [features(t.as_py(), bits) for t in batch["text"]]
        yield batch["grade"], [c for c, _ in rows], [v for _, v in rows]

    drawn = cut(map_rows(usable, described, "grade int, columns array<int>, values array<float>"))
    often = drawn.select(F.explode("columns").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    total = drawn.count()
    if not total:
        return Model(weights.astype(np.float32), np.log(np.arange(1, grades) / np.arange(1, grades)[::-1]), bits)
    sizes = {r["grade"]: r["n"] for r in drawn.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    weigh = np.array([total / len(sizes) / sizes[g] if g in sizes else 0.0 for g in range(grades)])
    active = np.array(sorted(r["c"] for r in often.where(F.col("n") >= min(seen, max(1, total // 10))).select("c").collect()), dtype=np.int64)
    place = np.full(len(weights), -1, dtype=np.int32)
    place[active] = np.arange(len(active))

    def packed(batch):
        rows = [(place[c.values.to_numpy()], v.values.to_numpy()) for c, v in zip(batch["columns"], batch["values"], strict=True)]
        rows = [(c[c >= 0], v[c >= 0]) for c, v in rows]
        yield batch["grade"], [c for c, _ in rows], [v for _, v in rows]

    small = cut(map_rows(drawn.coalesce(TASKS), packed, "grade int, columns array<int>, values array<float>"))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, free = x[: len(active)], x[len(active) :]

        def each(batch):
            lengths = [len(c.values) for c in batch["columns"]]
            keep = [i for i, n in enumerate(lengths) if n]
            if not keep:
                return
            starts = np.concatenate(([0], np.cumsum([lengths[i] for i in keep])[:-1])).astype(np.int64)
            columns, values = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("columns", "values"))
            got, of_w, of_f = _loss(w, free, columns, values.astype(np.float64), starts, batch["grade"].to_numpy(zero_copy_only=False)[keep], weigh)
            yield [got], [np.concatenate((of_w, of_f)).tobytes()]

        value, slope = 0.0, np.zeros(len(x))
        for part in map_rows(small, each, "value double, slope binary", rows=sample).collect():
            value += part["value"]
            slope += np.frombuffer(part["slope"])
        return value / total + ridge / 2 * float(w @ w), slope / total + ridge * np.concatenate((w, np.zeros(len(free))))

    start = np.concatenate((np.zeros(len(active)), [-0.7], np.full(grades - 2, 0.3)))
    x = _descend(loss, start, rounds)
    weights[active] = x[: len(active)]
    return Model(weights.astype(np.float32), _ordered(x[len(active) :]), bits)


def grade_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_grade, tails array<double>) for each row of ``docs``;
    tails[j - 1] is P(grade >= j). Whole texts are scored; a null text counts as
    empty; repeated rows stay."""

    def each(batch):
        tails = [model.tails(t.as_py()) for t in batch["text"]]
        yield batch["doc_id"], [float(t.sum()) for t in tails], [t.tolist() for t in tails]

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), each, "doc_id long, expected_grade double, tails array<double>")


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for toxic, 1 for low quality, 2 for good text; rows with a
    null in their label are left out. Of several labels of one document the
    lowest grade holds."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def select(docs: DataFrame, model: Model, grade: int, at_least: float) -> DataFrame:
    """The rows of ``docs`` whose tail probability of ``grade`` is ``at_least`` that;
    columns stay. The decision is made row by row in the scan, without a shuffle; rows
    pass through as Arrow batches."""

    def kept(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([float(model.tails((t.as_py() or "").encode())[grade - 1]) >= at_least for t in texts], type=pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(kept, docs.schema)
