"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run of period q is a stretch in which words q apart are equal, of at least ``times``
periods and ``least`` words, that can't be made longer. Each word of such a run comes
at least ``times`` times in it. So a word that comes less often in a segment is in no
run of it and splits the segment; what is left is split again by its own counts until
nothing splits. Segments that survive are scanned lag by lag: a run of period q holds a
whole block [kq, kq + q) that equals the next one, so each lag looks at one block in q
words, n log n of them in all. Blocks are compared by prefix sums of a rolling hash and
what they propose is compared word by word.

Runs of a text depend on that text alone: one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

#: Periods and words that a run has at least.
TIMES, LEAST = 3, 24
#: The base of the rolling hash: odd, so that its powers never vanish.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))


def segments(ids: np.ndarray, times: int = TIMES, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, stop) of the stretches of ``ids`` in which each word comes ``times`` times
    or more and that have ``least`` words; every run lies whole in one of them."""
    open_ = [(0, len(ids))]
    while open_:
        start, stop = open_.pop()
        if stop - start < least:
            continue
        part = ids[start:stop]
        low = int(part.min())
        span = int(part.max()) - low + 1
        # Counts by number where numbers are dense, else by sorting.
        here = part - low if span <= 4 * len(part) else np.unique(part, return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(here)[here] < times)
        if not len(rare):
            yield start, stop
            continue
        ends = np.concatenate(([-1], rare, [len(part)]))
        long = np.flatnonzero(np.diff(ends) > least)
        open_ += [(start + int(ends[i]) + 1, start + int(ends[i + 1])) for i in long]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading members are equal."""
    at, step = 0, 64
    while at < len(a):
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return len(a)


def _scan(ids: np.ndarray, times: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n = len(ids)
    draw = np.random.default_rng(n).integers(0, 1 << 64, int(ids.max()) + 1, dtype=np.uint64)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(draw[ids] * power[:n])))
    covered = np.zeros(n, dtype=np.int64)  # where the longest run over a word ends
    found = []
    for q in range(1, n // times + 1):
        blocks = np.diff(sums[::q])
        same = np.flatnonzero(blocks[:-1] * power[q] == blocks[1:])
        done = -1
        for k in same.tolist():
            at = k * q
            # Two equal blocks inside of a run of a shorter period are that run's.
            if at <= done or covered[at] >= at + 2 * q or not np.array_equal(ids[at : at + q], ids[at + q : at + 2 * q]):
                continue
            right = at + q + _reach(ids[at + q : n - q], ids[at + 2 * q :])
            left = at - _reach(ids[:at][::-1], ids[q : at + q][::-1])
            done = right - 1
            if right + q - left >= max(least, times * q):
                found.append((left, right + q - left, q))
                covered[left : right + q] = np.maximum(covered[left : right + q], right + q)
    return found


def runs(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    ids = numbered(words)
    return sorted((start + s, length, q) for start, stop in segments(ids, times, least) for s, length, q in _scan(ids[start:stop], times, least))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in found:
        edges[start + q] += 1
        edges[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not gone]


def highest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones the first, then the one of the shortest period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def repeated_tail(words: list[bytes], h: int) -> list[bytes]:
    """Words with a repeated tail for one in ten values of ``h``, else the words."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find(docs: DataFrame, planted: bool = False, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, highest struct or null,
    kept binary) for each row of ``docs``: the runs of its words, the one with the
    most periods, and the words that stay, joined by a space.

    ``planted`` repeats the tails of one document in ten first, by the checksum of
    its doc_id; a null doc_id has none. Null and blank texts have no words and no
    runs. Repeated rows stay repeated, further columns play no part, and an empty
    table gives an empty result. A word is never cut: words are what lies between
    ASCII white space, whatever the case.
    """
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None)
    texts = docs.select("doc_id", text_bytes().alias("text"), mark.cast("long").alias("mark"))

    def fields(run):
        return run and dict(zip(("start", "length", "period"), run, strict=True))

    def each(batch):
        all_runs, best, kept = [], [], []
        for text, h in zip(batch["text"], batch["mark"].to_pylist(), strict=True):
            words = text.as_py().split()
            words = words if h is None else repeated_tail(words, h)
            got = runs(words, times, least) if len(words) >= least else []
            all_runs.append([fields(r) for r in got])
            best.append(fields(highest(got)))
            kept.append(b" ".join(collapsed(words, got)))
        yield batch["doc_id"], all_runs, best, kept

    one = "struct<start:bigint,length:bigint,period:bigint>"
    return map_rows(texts, each, f"doc_id long, runs array<{one}>, highest {one}, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """The runs of ``find`` as numbers and digests, a row for each document."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = [F.col(f"highest.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *best,
        F.floor(F.expr("1000 * highest.length div highest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
