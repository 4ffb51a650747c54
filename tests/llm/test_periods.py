import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from sluice.llm import periods
from sluice.llm import queries as Q


def brute(w):
    """Every lag, every stretch; it counts if no shorter lag holds all over it."""
    names = {x: i for i, x in enumerate(sorted(set(w)))}
    ids, out = np.array([names[x] for x in w], dtype=np.int64), []
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate(([0], ids[:-q] == ids[q:], [0])).astype(np.int8)
        turns = np.diff(same)
        for i, j in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True):
            length = j + q - i
            part = ids[i : i + length]
            if length >= max(24, 3 * q) and not any(np.array_equal(part[d:], part[: length - d]) for d in range(1, q)):
                out.append((i, length, q))
    return sorted(out)


def expected(doc_id, text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    got = brute(w)
    gone = {x for s, length, q in got for x in range(s + q, s + length)}
    best = min(got, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join("%d,%d,%d\n" % r for r in got)
    return (len(got), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def rows(frame):
    return [(r["doc_id"], (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])) for r in frame.collect()]


def words_with_runs(rng, n):
    k = rng.choice([1, 2, 2, 3, 5, 40])
    w = [b"%d" % rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        at, times = rng.randrange(n + 1), rng.randint(1, 100)
        unit = [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 30))]
        w[at : at + rng.randint(0, times)] = (unit * times)[:times]
    return w


def test_runs_against_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        w = words_with_runs(rng, rng.randint(0, 120))
        assert periods.runs(w) == brute(w)


def test_segments_hold_every_run():
    rng = random.Random(5)
    for _ in range(300):
        w = words_with_runs(rng, rng.randint(24, 200))
        ids = periods.numbered(w)
        parts = list(periods.segments(ids))
        assert all(sum(ids[a:b] == x) >= 3 for a, b in parts for x in set(ids[a:b].tolist()))
        assert all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in brute(w))


def test_long_texts():
    unit = [b"%d" % i for i in range(30_000)]
    assert periods.runs(unit * 3) == [(0, 90_000, 30_000)]
    assert periods.runs(unit * 2) == []
    assert periods.runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert periods.runs([b"x", *[b"a", b"b"] * 50_000, b"y"]) == [(1, 100_000, 2)]


def test_bounds_of_a_run():
    unit = [b"%d" % i for i in range(8)]
    assert periods.runs(unit * 3) == [(0, 24, 8)] and periods.runs((unit * 3)[:-1]) == []
    assert periods.runs([b"a"] * 24) == [(0, 24, 1)] and periods.runs([b"a"] * 23) == []
    assert periods.collapsed(unit * 3, [(0, 24, 8)]) == unit
    assert periods.highest([(9, 24, 8), (0, 30, 10), (0, 9, 3), (50, 24, 8)]) == (0, 9, 3)


def test_query_against_brute_force(spark, tiny, docs):
    got = dict(rows(Q.op13_periodic_runs(spark, tiny)))
    assert got == {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs.collect()}
    assert any(v[0] for v in got.values())


def test_odd_rows(odd, none):
    found = periods.digests(periods.find(odd, planted=True))
    assert sorted(rows(found), key=repr) == sorted(((r["doc_id"], expected(r["doc_id"], r["text"])) for r in odd.collect()), key=repr)
    assert periods.digests(periods.find(none, planted=True)).count() == 0
    plain = periods.find(odd).where("doc_id = 9").first()
    assert [tuple(r) for r in plain["runs"]] == [(0, 480, 1)] and bytes(plain["kept"]) == b"ab"
