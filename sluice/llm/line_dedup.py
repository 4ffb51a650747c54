"""Line deduplication by a deletion-neighbourhood join.

Two lines are near if at most one word is inserted, deleted or replaced. Every
line that may have a near partner emits all its variants with one word deleted,
as hashed keys; lines that meet in a variant are near. Within a key the earliest
line is found by grouped minima, so no pairs are formed, and the edit distance of
each hit is verified on the words. Equal lines meet by the hash of all words.

A line can only have a near partner if another line has the same length, give or
take a word, and the same first or last half: the edit leaves one half alone.
Lines without such a partner emit no variants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, map_rows, row_key, text_bytes

#: Lines of fewer words are compared as a whole only: one word is too much of them.
MIN_WORDS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LAST = (1 << 63) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def variant_keys(words: list[bytes]) -> np.ndarray:
    """Hash of the line, then of each variant without one word."""
    n = len(words)
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * power, dtype=np.uint64)))
        out = np.concatenate((sums[-1:], sums[:-1] + (sums[-1] - sums[1:]) * _BACK))
        return ((out ^ (out >> np.uint64(29))) * _BASE).view(np.int64)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """True if at most one word is inserted, deleted or replaced between a and b."""
    if abs(len(a) - len(b)) > 1:
        return False
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    left_a, left_b = a[start:], b[start:]
    if len(a) == len(b):
        return left_a[1:] == left_b[1:]
    longer, shorter = (left_a, left_b) if len(a) > len(b) else (left_b, left_a)
    return longer[1:] == shorter


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with words: whole (its hash), words, the hashes of its
    halves, two in a number, and doc, rid, line, by which earlier and later are told."""

    def digest(words):
        return xxhash.xxh64_intdigest(b" ".join(words))

    def halves(w, m):
        return _signed((digest(w[:m]) >> 32 << 32) | (digest(w[len(w) - m :]) >> 32))

    def each(batch):
        out = []
        for doc, rid, text in zip(batch["doc_id"].to_pylist(), batch["rid"].to_pylist(), batch["text"], strict=True):
            for line, raw in enumerate(text.as_py().split(b"\n")):
                w = raw.split()
                n = len(w)
                if n:
                    pair = (halves(w, n // 2), halves(w, (n - 1) // 2)) if n >= min_words else (None, None)
                    out.append((doc, rid, line, _signed(digest(w)), n, *pair))
            if len(out) > 20_000:
                yield tuple(map(list, zip(*out, strict=True)))
                out = []
        if out:
            yield tuple(map(list, zip(*out, strict=True)))

    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), row_key().alias("rid"), text_bytes().alias("text"))
    return map_rows(rows, each, "doc long, rid long, line int, whole long, words int, halves long, halves_less long")


def _candidates(classes: DataFrame) -> DataFrame:
    """Those classes of equal lines that share a half with another one of fitting length."""
    n = F.col("words")
    keys = [F.xxhash64(F.lit(kind), length, F.lit(side), half(column)) for kind, length, column in ((0, n, "halves"), (1, n + 1, "halves"), (1, n, "halves_less")) for side, half in enumerate((lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))))]
    keyed = classes.where("halves is not null").select("whole", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    return classes.join(shared.select("whole").distinct(), "whole").select("at")


def near_duplicates(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "removed") -> DataFrame:
    """``docs`` with all columns, the text without duplicate lines, and one more
    column (``removed``) with the numbers of the lines taken out, from 0.

    A line goes if an earlier line, in order of doc_id, row and line, is equal
    word for word or, from ``min_words`` words on, within one edit of a word.
    White space within lines does not count; lines without words stay. A null
    text stays null; rows without a doc_id come last; rows with equal doc_id and
    text are one document and stay repeated; an empty table gives none. A column of
    ``docs`` with the name ``removed`` stands for is replaced by it.
    """
    docs = docs.drop(removed)
    columns = docs.columns
    lines = cut(_lines(docs, min_words)).withColumn("at", F.struct("doc", "rid", "line"))
    classes = lines.groupBy("whole").agg(F.min("at").alias("at"), *[F.min(c).alias(c) for c in ("words", "halves", "halves_less")])
    repeats = lines.join(classes.select("whole", F.col("at").alias("low")), "whole").where("at <> low").select("at", F.lit(None).cast("binary").alias("witness"))

    # Names of no column of the table.
    rid, raw, ask, marked = (fresh(docs, n) for n in ("rid", "raw", "ask", "marks"))
    keyed = docs.withColumns({rid: row_key(), raw: text_bytes()})
    asked = _candidates(classes).groupBy(F.col("at.rid").alias(rid)).agg(F.collect_list("at").alias(ask))

    def variants(batch):
        for text, wanted in zip(batch[raw], batch[ask].to_pylist(), strict=True):
            split, out = text.as_py().split(b"\n"), []
            for at in wanted:
                out.append((at, variant_keys(split[at["line"]].split())))
            yield (np.concatenate([k for _, k in out]), np.concatenate([np.arange(-1, len(k) - 1) for _, k in out]).astype(np.int32), *[pa.array(np.repeat(np.array([a[f] for a, _ in out], dtype=np.int64), [len(k) for _, k in out])) for f in ("doc", "rid", "line")])

    met = map_rows(keyed.join(asked.hint("shuffle_hash"), rid), variants, "key long, gap int, doc long, rid long, line int")
    met = met.select("key", "gap", F.struct("doc", "rid", "line").alias("at"))
    by_key, by_gap = Window.partitionBy("key"), Window.partitionBy("key", "gap")
    low = F.when(F.col("gap") < 0, F.min("at").over(by_key)).otherwise(F.least(F.min("at").over(by_gap), F.min(F.when(F.col("gap") < 0, F.col("at"))).over(by_key)))
    hits = met.withColumn("low", low).where("low < at").groupBy("at").agg(F.min("low").alias("low"))

    lent = hits.groupBy(F.col("low.rid").alias(rid)).agg(F.collect_list(F.struct("at", F.col("low.line").alias("from"))).alias(ask))

    def witnesses(batch):
        for text, wanted in zip(batch[raw], batch[ask].to_pylist(), strict=True):
            split = text.as_py().split(b"\n")
            yield [a["at"]["rid"] for a in wanted], [a["at"]["line"] for a in wanted], [split[a["from"]] for a in wanted]

    near = map_rows(keyed.join(lent.hint("shuffle_hash"), rid), witnesses, "rid long, line int, witness binary")
    marks = repeats.select("at.rid", "at.line", "witness").union(near).groupBy(F.col("rid").alias(rid)).agg(F.collect_list(F.struct("line", "witness")).alias(marked))

    at = columns.index("text")
    schema = [f for f in docs.schema.fields if f.name != "text"]

    def cleaned(batch):
        texts, lost = [], []
        for original, text, marks in zip(batch["text"], batch[raw], batch[marked].to_pylist(), strict=True):
            gone = set()
            if marks:
                split = text.as_py().split(b"\n")
                gone = {m["line"] for m in marks if m["witness"] is None or within_one_edit(split[m["line"]].split(), m["witness"].split())}
                texts.append(b"\n".join(l for i, l in enumerate(split) if i not in gone).decode("utf-8", "replace"))
            else:
                texts.append(original.as_py())
            lost.append(sorted(gone))
        rest = [batch[f.name] for f in schema]
        yield (*rest[:at], texts, *rest[at:], lost)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{removed}` array<int>"
    return map_rows(keyed.join(marks.hint("shuffle_hash"), rid, "left"), cleaned, ddl)


def clean(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without duplicate lines; rows that lose all their lines go, columns stay."""
    lines = fresh(docs, "lines")
    found = near_duplicates(docs, removed=lines, **options)
    return found.where((F.size(lines) == 0) | (F.length(F.regexp_replace("text", r"\s+", "")) > 0)).select(*docs.columns)
