"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint is split into blocks. Two fingerprints that differ in at most
``blocks - pick`` bits agree in at least ``pick`` whole blocks, so every
close pair meets under some choice of that many blocks (``pick``). Members of a bucket are
compared by their Hamming distance; only a spanning forest of the close pairs of
a bucket leaves the task, which keeps connectivity and grows linearly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, fresh, lookup_join, map_rows, row_key, text_bytes

#: Members of a bucket that one unit of work compares; a larger bucket is dealt
#: into chunks and every pair of chunks becomes a unit.
CHUNK = 4096
_PIECE = 1 << 15


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; a shorter text is one shingle."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[s:e], seed) for s, e in spans], dtype=np.uint64)


def print_of(hashes: np.ndarray) -> int:
    """64 bits as a signed long; a bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _PIECE):
        piece = np.ascontiguousarray(hashes[at : at + _PIECE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    return print_of(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, rid, fp long) for each row of ``docs``; rid is one key for rows with
    equal doc_id and text; a null or blank text has fingerprint 0."""

    def each(batch):
        yield batch["doc_id"], batch["rid"], [fingerprint(t.as_py(), words, seed) for t in batch["text"]]

    return map_rows(docs.select("doc_id", row_key().alias("rid"), text_bytes().alias("text")), each, "doc_id long, rid long, fp long")


def nearest_forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int, int]]:
    """(a, b, distance): a minimum spanning forest of the pairs of ``values``
    within ``max_bits``, grown from one member at a time."""
    size = len(values)
    # NumPy counts the bits of a signed number's absolute value.
    bits = values.view(np.uint64)
    best = np.full(size, 65, dtype=np.int64)
    parent, out = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    links = []
    for _ in range(size):
        reach = np.where(out, 127, best)
        at = int(reach.argmin())
        if best[at] <= max_bits:
            links.append((int(values[parent[at]]), int(values[at]), int(best[at])))
        out[at] = True
        far = np.bitwise_count(bits ^ bits[at]).astype(np.int64)
        closer = far < best
        best[closer], parent[closer] = far[closer], at
    return links


def close_links(prints: DataFrame, max_bits: int, blocks: int, pick: int) -> DataFrame:
    """(a, b, bits): links between distinct fingerprints (column fp) that connect
    every pair within ``max_bits`` bits through links within ``max_bits`` bits.
    This holds for ``max_bits`` up to ``blocks - pick``; of pairs further apart
    those that share ``pick`` blocks are found."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (e - s)) - 1) << s for s, e in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(block, pick)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp").distinct().select("fp", F.posexplode(F.array(*map(F.lit, signed))).alias("c", "mask")).select("c", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    sizes = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(sizes, ["c", "key"]).withColumn("parts", F.ceil(F.col("n") / CHUNK)).withColumn("own", F.pmod(F.xxhash64("fp"), "parts"))
    units = dealt.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).groupBy("c", "key", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v")).agg(F.collect_list("fp").alias("fps"))

    def each(batch):
        links = []
        for fps in batch["fps"]:
            values = fps.values.to_numpy(zero_copy_only=False)
            if len(values) == 2:
                bits = (int(values[0]) ^ int(values[1])) & ((1 << 64) - 1)
                if bits.bit_count() <= max_bits:
                    links.append((int(values[0]), int(values[1]), bits.bit_count()))
            elif len(values) > 2:
                links += nearest_forest(np.array(values), max_bits)
        yield tuple(map(list, zip(*links, strict=True))) if links else ([], [], [])

    found = map_rows(units.select("fps"), each, "a long, b long, bits int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").distinct()


def _labelled(docs: DataFrame, words: int, max_bits: int, blocks: int, pick: int, seed: int) -> DataFrame:
    """(doc_id, rid, fp, label, component_id) of each row of ``docs``."""
    prints = cut(fingerprints(docs, words, seed))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = close_links(prints, max_bits, blocks, pick)
    label = connected_components(links.select("a", "b"))
    named = first.join(label, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(smallest, "label").select("fp", "label", "component_id"), "fp")


def groups(docs: DataFrame, words: int = 3, max_bits: int = 3, blocks: int = 6, pick: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): the near-duplicate group of each row of ``docs``.

    Rows with one fingerprint are one node, so copies cost nothing. Links join
    fingerprints within ``max_bits`` bits. component_id is the smallest doc_id of the group. Empty and null texts share fingerprint
    0; repeated rows stay repeated; a null doc_id is never the smallest unless
    its group has no other; an empty table gives an empty result.
    """
    return _labelled(docs, words, max_bits, blocks, pick, seed).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, words: int = 3, seed: int = 42, min_similarity: float | None = None, max_bits: int = 3, blocks: int = 6, pick: int = 3) -> DataFrame:
    """One row of each group of ``docs``: the one with the smallest doc_id, a null one
    last; of several with that doc_id the one whose key of doc_id and text is least.

    With ``min_similarity`` the groups are those of all pairs whose shingle sets
    are that similar (Jaccard): blocks of fingerprints propose pairs, and what
    they leave out a prefix filter finds (see ``jaccard``). Without it,
    fingerprints within ``max_bits`` bits are linked unverified. Columns and
    their order stay; of rows with equal doc_id and text one stays. Texts with one
    doc_id and different contents are documents of their own.
    """
    from . import jaccard

    found = _labelled(docs, words, max_bits, blocks, pick, seed) if min_similarity is None else jaccard.groups(docs, min_similarity, words, seed, max_bits, blocks, pick)
    found = cut(found.select("doc_id", "rid", "label").groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.count("*").alias("many")))
    kept = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("kept"), F.count("*").alias("members"))
    kept = cut(kept)
    gone = found.join(kept.where("members > 1"), "label").where("rid <> kept").select("rid")
    twice = found.where("many > 1").join(kept, "label").where("rid = kept").select("rid")
    rid = fresh(docs, "rid")
    keyed = docs.withColumn(rid, row_key())
    once = lookup_join(keyed, gone.union(twice).withColumnRenamed("rid", rid), rid, "left_anti")
    again = lookup_join(keyed, twice.withColumnRenamed("rid", rid), rid, "left_semi").dropDuplicates([rid])
    return once.unionByName(again).select(*docs.columns)
