import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import line_dedup
from sluice.llm import queries as Q

LAST = (1 << 63) - 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_one_edit(a, b):
    assert line_dedup.within_one_edit(a, b) == (distance(a, b) <= 1)


def brute(rows, minimum=line_dedup.MIN_WORDS):
    """Removed line numbers by document; near classes come from deletions of words."""
    first, seen = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").encode().split(b"\n")):
            w = tuple(line.split())
            if w:
                seen.append((doc, i, w))
                first.setdefault(w, (doc, i))
    meet = defaultdict(set)
    for w in first:
        if len(w) >= minimum:
            for v in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
                meet[v].add(w)
    near = {a for v in meet.values() for a in v for b in v if first[b] < first[a] and distance(a, b) <= 1}
    out = defaultdict(list)
    for doc, i, w in seen:
        if first[w] != (doc, i) or w in near:
            out[doc].append(i)
    return out


def test_query_against_brute_force(spark, tiny, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute(list(rows.items()))
    for r in Q.op5_line_dedup(spark, tiny).collect():
        assert list(r["removed"]) == want.get(r["doc_id"], [])
        kept = "\n".join(l for i, l in enumerate(rows[r["doc_id"]].split("\n")) if i not in set(r["removed"]))
        assert hashlib.sha256(kept.encode()).hexdigest() == r["kept_sha256"]


def test_edits_at_every_place(spark):
    base = "a b c d e f g h i j".split()
    lines = [base]
    for i in range(len(base)):
        lines += [base[:i] + ["X%d" % i] + base[i + 1 :], base[:i] + base[i + 1 :], base[:i] + ["Y%d" % i] + base[i:]]
    lines += [["Z", *base[1:-1], "Z"], base[:7], "p p p p p p p p q".split(), "p p p p p p p p".split(), "p p p p p p p p p q".split()]
    df = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(lines)], "doc_id long, text string, n int")
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.near_duplicates(df).collect()}
    want = brute([(i, " ".join(w)) for i, w in enumerate(lines)])
    assert got == {i: want.get(i, []) for i in range(len(lines))}


def test_odd_rows(odd, none):
    rows = line_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    gone = {}
    for r in rows:
        gone.setdefault(r["doc_id"], []).append(list(r["removed"]))
    assert gone[1] == [[]] and gone[2] == [[]] and gone[3] == [[]] and gone[4] == [[0]]
    assert gone[5] == [[], []] and gone[6] == [[0, 3]] and gone[7] == [[]]
    assert [1] in gone[None]
    assert [r["text"] for r in rows if r["doc_id"] == 6] == ["\n \t"] and [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    kept = line_dedup.clean(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 5, 5, 7, 8, 9]
    assert line_dedup.near_duplicates(none).count() == 0


def test_clashing_names(spark, odd):
    names = ("rid", "raw", "ask", "marks", "removed", "lines", "doc", "words")
    df = odd.select("doc_id", "text", *[F.lit(7).alias(n) for n in names])
    want = sorted((repr(r["doc_id"]), r["text"], list(r["removed"])) for r in line_dedup.near_duplicates(odd.select("doc_id", "text")).collect() if r["text"])
    rows = line_dedup.near_duplicates(df).collect()
    assert sorted((repr(r["doc_id"]), r["text"], list(r["removed"])) for r in rows if r["text"]) == want and all(r["rid"] == r["raw"] == 7 for r in rows)
    assert line_dedup.clean(df).columns == df.columns
