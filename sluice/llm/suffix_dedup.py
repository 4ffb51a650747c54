"""Removal of repeated passages by bucket-pointer refinement of suffixes.

Positions are put into buckets by the q-gram that starts there, and buckets are
refined by identifiers at later offsets: the identifier at depth 2h of a position
comes from its identifier at depth h and that of the position h further on, and
each depth reuses the identifiers of the one before. Two strings of the length
asked for are equal if their identifiers at that depth are.

Only sampled suffixes enter the shuffle. The sample is chosen by content: in each
window of the length asked for, the q-gram with the smallest identifier. Equal
windows choose the same q-gram at the same offset, so a window can only be
repeated if the bucket of its q-gram has another member. Buckets of one are done.
The others are refined by the identifiers of the whole stretch of windows that
share the q-gram; where a whole stretch recurs, all of it is repeated, and the
stretches left over are refined window by window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

LENGTH = 200
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 34) - 1)
_PIECE = 1 << 20
#: Windows that are refined together before they are refined one by one.
BLOCK = 16


def _joined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifier of a pair of identifiers."""
    with np.errstate(over="ignore"):
        out = (first ^ (first >> np.uint64(32))) * _A + later * _B
    return out ^ (out >> np.uint64(29))


def _depth(length: int) -> int:
    """Length of the initial q-grams: the largest power of two up to a sixth of the length."""
    return 1 << max(0, (length // 6).bit_length() - 1)


def identifiers(raw: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Identifiers of every position at each of the depths ``lengths``; a depth that
    is no power of two joins two overlapping strings of the power below it."""
    now, depth, out = raw.astype(np.uint64) + np.uint64(1), 1, {}
    while True:
        for n in lengths:
            if depth <= n < 2 * depth:
                out[n] = _joined(now[: max(0, len(now) - (n - depth))], now[n - depth :]) if n > depth else now
        if 2 * depth > max(lengths):
            return [out[n] for n in lengths]
        now = _joined(now[:-depth], now[depth:])
        depth *= 2


def _bounds(texts: list[bytes], length: int) -> np.ndarray:
    """Starts of windows within one text each, in the texts put together."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    has = sizes >= length
    np.add.at(inside, begins[has], 1)
    np.add.at(inside, begins[has] + sizes[has] - length + 1, -1)
    return np.flatnonzero(np.cumsum(inside)[:-1])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(start, last, place, gram, whole): the runs of windows start .. last that
    choose the q-gram at place, its identifier, and that of the whole stretch."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    windows = _bounds(texts, length)
    if not len(windows):
        return (np.empty(0, np.int64),) * 5
    grams, whole = identifiers(raw, [_depth(length), length])
    width = length - _depth(length) + 1
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    chosen = (least[windows] & _LOW).astype(np.int64)
    edge = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(windows) != 1)) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(windows)])) - 1
    start, end, place = windows[first], windows[last], chosen[first]
    stretch = _joined(_joined(whole[start], whole[end]), ((place - start) * length + place - end).astype(np.uint64))
    return start, end, place, grams[place].view(np.int64), stretch.view(np.int64)


def _pieces(sizes: list[int]):
    """Slices of rows of about _PIECE bytes."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= _PIECE):
            size += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def _stretches(rows: DataFrame, length: int) -> DataFrame:
    """anchors() of every text: (gram, whole, at: (rid, place, start, last))."""

    def each(batch):
        texts, rids = batch["text"].to_pylist(), batch["rid"].to_numpy()
        for piece in _pieces([len(t) for t in texts]):
            begins = np.concatenate(([0], np.cumsum([len(t) for t in texts[piece]])))
            start, last, place, gram, whole = anchors(texts[piece], length)
            if len(start):
                of = np.searchsorted(begins, start, side="right") - 1
                yield gram, whole, rids[piece][of], place - begins[of], start - begins[of], last - begins[of]

    found = map_rows(rows.select("rid", "text"), each, "gram long, whole long, rid long, place int, start int, last int")
    return found.select("gram", "whole", F.struct("rid", "place", "start", "last").alias("at"))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, stop>>, kept binary) for each row
    of ``docs``: the maximal runs of bytes covered by a string of ``length`` bytes
    that also starts anywhere else in the table, and the text without them.

    A null text is empty; a text shorter than ``length`` has no spans; equal rows
    are elsewhere to each other; an empty table gives none. What is left need not
    be valid UTF-8. The texts are dealt by row once and that exchange serves every
    pass over them.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", text_bytes().alias("text"))

    # Buckets and the stretches in them. A stretch that recurs is repeated as a
    # whole. Of a bucket with other stretches too, those that don't recur, and one
    # of each that does, are asked again.
    bucket, same = Window.partitionBy("gram"), Window.partitionBy("gram", "whole")
    told = _stretches(rows, length).withColumn("n", F.count("*").over(same)).withColumn("chosen", F.min("at").over(same) == F.col("at"))
    told = told.withColumn("mixed", F.min("whole").over(bucket) < F.max("whole").over(bucket)).withColumn("least", F.min("n").over(bucket))
    told = told.select("at", (F.col("n") > 1).alias("mark"), (F.col("mixed") & (F.col("least") == 1) & F.col("chosen")).alias("ask")).where("mark or ask")
    first = told.groupBy(F.col("at.rid").alias("__rid")).agg(F.collect_list(F.struct("at.place", "at.start", "at.last", "mark", "ask")).alias("__told"))

    def blocks(batch):
        for rid, text, told in zip(batch["rid"].to_pylist(), batch["text"], batch["__told"], strict=True):
            core, whole = identifiers(np.frombuffer(text.as_py(), dtype=np.uint8), [length - BLOCK + 1, length])
            asked = told.values.field("ask").to_numpy(zero_copy_only=False)
            place, start, last = (told.values.field(f).to_numpy()[asked] for f in ("place", "start", "last"))
            alone = ~told.values.field("mark").to_numpy(zero_copy_only=False)[asked]
            low, high = (place - last) // BLOCK, (place - start) // BLOCK
            own = np.repeat(np.arange(len(place)), high - low + 1)
            block = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
            near, far = np.maximum(place[own] - last[own], block * BLOCK), np.minimum(place[own] - start[own], block * BLOCK + BLOCK - 1)
            begin, end = place[own] - far, place[own] - near
            cores = _joined(core[place[own] - block * BLOCK], block.astype(np.uint64))
            hulls = _joined(_joined(whole[begin], whole[end]), (near * length + far).astype(np.uint64))
            yield cores.view(np.int64), hulls.view(np.int64), np.full(len(own), rid), begin, (end - begin).astype(np.int8), alone[own]

    asking = rows.join(first.where(F.exists("__told", lambda t: t["ask"])).hint("shuffle_hash"), F.col("rid") == F.col("__rid"))
    core = Window.partitionBy("core")
    met = map_rows(asking, blocks, "core long, hull long, rid long, start int, more byte, alone boolean")
    met = met.withColumn("n", F.count("*").over(core)).withColumn("mixed", F.min("hull").over(core) < F.max("hull").over(core)).where("n > 1 and (alone or mixed)")
    second = met.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("start", "more", "alone", "mixed")).alias("__met"))

    def windows(batch):
        for rid, text, met in zip(batch["rid"].to_pylist(), batch["text"], batch["__met"], strict=True):
            (whole,) = identifiers(np.frombuffer(text.as_py(), dtype=np.uint8), [length])
            open_ = met.values.field("mixed").to_numpy(zero_copy_only=False)
            start, sizes = met.values.field("start").to_numpy()[open_], met.values.field("more").to_numpy()[open_].astype(np.int64) + 1
            at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            yield whole[at].view(np.int64), np.full(len(at), rid), at, np.repeat(met.values.field("alone").to_numpy(zero_copy_only=False)[open_], sizes)

    asking = rows.join(second.where(F.exists("__met", lambda t: t["mixed"])).hint("shuffle_hash"), F.col("rid") == F.col("__rid"))
    single = map_rows(asking, windows, "window long, rid long, start int, alone boolean")
    again = single.withColumn("n", F.count("*").over(Window.partitionBy("window"))).where("n > 1 and alone")
    third = again.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list("start").alias("__single"))

    def removed(batch):
        spans, kept = [], []
        for text, told, met, single in zip(batch["text"], batch["__told"], batch["__met"], batch["__single"], strict=True):
            raw = np.frombuffer(text.as_py(), dtype=np.uint8)
            change = np.zeros(len(raw) + 1, dtype=np.int32)

            def cover(start, last, change=change):
                np.add.at(change, start, 1)
                np.add.at(change, last + length, -1)

            if told.values is not None:
                whole = told.values.field("mark").to_numpy(zero_copy_only=False)
                cover(told.values.field("start").to_numpy()[whole], told.values.field("last").to_numpy()[whole])
            if met.values is not None:
                whole = met.values.field("alone").to_numpy(zero_copy_only=False) & ~met.values.field("mixed").to_numpy(zero_copy_only=False)
                start = met.values.field("start").to_numpy()[whole]
                cover(start, start + met.values.field("more").to_numpy()[whole])
            if single.values is not None:
                cover(single.values.to_numpy(), single.values.to_numpy())
            covered = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).view(np.int8))).tolist()
            spans.append([{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(raw[~covered].tobytes() if edge else text.as_py())
        yield batch["doc_id"], [len(t.as_py()) for t in batch["text"]], spans, kept

    everything = rows
    for part, name in ((first, "__told"), (second, "__met"), (third, "__single")):
        everything = everything.join(part.withColumnRenamed("__rid", f"{name}_rid").hint("shuffle_hash"), F.col("rid") == F.col(f"{name}_rid"), "left")
    return map_rows(everything, removed, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
