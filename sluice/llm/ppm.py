"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` symbols, held as a table of
counts of (context, symbol). A symbol is coded in the longest context that has
been seen; a context that lacks it escapes to the next shorter one with the
share of its distinct symbols (method C), and symbols of the longer context are
excluded there. Code lengths are worked out once per distinct (context, symbol)
by joins of count tables; no model is ever gathered in one place. Documents are
dealt into blocks; a block asks for the entries it needs and gets them by a join,
code lengths in single precision and counts of words exactly.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, text_bytes

ORDER = 5
#: Bytes of text in a block, about.
BLOCK = 40 << 20
#: A symbol takes 9 bits: the start that pads contexts, the end of a text, bytes from 2 on.
_BITS, _START, _END, _FIRST = 9, 0, 1, 2
SYMBOLS = 257
_PIECE = 2 << 20
#: Words of which a worker holds objects at once, about.
WORDS = 100_000
#: Keys of grams are not negative, those of words are; the end of a text as a word has its own.
STOP = 1 << 62
#: Stands for the value of a gram that training has not seen.
_UNSEEN = -1e9


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): the context and symbol at every byte and at the end of each
    text, one text after the other, and where each text begins."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    size = int(lengths.sum()) + (ORDER + 1) * len(texts)
    symbols = np.zeros(size, dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + ORDER + 1)[:-1]))
    body = np.ones(size, dtype=bool)
    for i in range(ORDER):
        body[begins + i] = False
    ends = begins + ORDER + lengths
    inner = body.copy()
    inner[ends] = False
    symbols[inner] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + _FIRST
    symbols[ends] = _END
    keys = symbols.copy()
    for i in range(1, ORDER + 1):
        keys[i:] |= symbols[:-i] << (_BITS * i)
    return keys[body], np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))


def _pieces(texts: list[bytes]):
    """Runs of texts of about _PIECE bytes, each with its slice."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _PIECE):
            size += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and where each begins in the sorted keys."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], first


def _tallied(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of texts and their counts."""
    found, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for piece in _pieces(texts):
        keys = grams(texts[piece])[0]
        distinct, first = _distinct(keys)
        found.append(distinct)
        counts.append(np.diff(np.append(first, len(keys))))
    keys, counts = np.concatenate(found), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _word_keys(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64) | np.int64(-(1 << 63))


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the grams and words of texts, and of their ends, with counts."""
    grams_, n = _tallied(texts)
    words: Counter = Counter()
    for t in texts:
        words.update(t.lower().split())
    keys = np.concatenate((grams_, _word_keys(words), np.array([STOP] * bool(texts), dtype=np.int64)))
    return keys, np.concatenate((n, np.fromiter(words.values(), np.int64, len(words)), np.array([len(texts)] * bool(texts), dtype=np.int64)))


def _texts(column: pa.ChunkedArray):
    """The texts of a block, some _PIECE bytes of them at a time."""
    at, sizes = 0, pc.binary_length(column).to_pylist()
    while at < len(sizes):
        end, size = at + 1, sizes[at]
        while end < len(sizes) and size + sizes[end] <= _PIECE:
            size += sizes[end]
            end += 1
        yield column.slice(at, end - at).to_pylist()
        at = end


def keys_of_block(table: pa.Table) -> pa.Table:
    """Distinct keys of a block. Words are objects only as long as few have come
    together; of the others there are keys."""
    found, named, words = [], [np.array([STOP])], set()
    for texts in _texts(table["text"]):
        found.append(_distinct(grams(texts)[0])[0])
        for t in texts:
            words.update(t.lower().split())
        if len(words) >= WORDS:
            named.append(_word_keys(words))
            words = set()
    keys = np.concatenate((_distinct(np.concatenate(found))[0], _distinct(np.concatenate((*named, _word_keys(words))))[0]))
    del found, named, words
    pa.default_memory_pool().release_unused()
    return pa.table({"block": np.full(len(keys), table["block"][0].as_py(), dtype=np.int32), "key": keys})


class _Lookup:
    """Values of int64 keys, all of them present: a hashed table, and a sorted one
    for the keys whose slot was taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(1, int(2 * len(keys)).bit_length()))
        slots = self._slots(keys)
        self.keys, self.values = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64), np.zeros(1 << (64 - int(self.shift)), dtype=values.dtype)
        self.keys[slots], self.values[slots] = keys, values
        out = self.keys[slots] != keys
        order = np.argsort(keys[out])
        self.rest, self.rest_values = keys[out][order], values[out][order]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        values = self.values[slots]
        missed = np.flatnonzero(self.keys[slots] != keys)
        if len(missed):
            values[missed] = self.rest_values[np.searchsorted(self.rest, keys[missed])]
        return values


class _Counts(dict):
    """Counts of words, found by their keys (sorted, each once) when first asked for. At
    WORDS words it forgets them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        super().__init__()
        self.keys, self.counts = array("q", keys.tobytes()), array("d", counts.tobytes())

    def __missing__(self, word: bytes) -> float:
        key = (xxhash.xxh64_intdigest(word) | 1 << 63) - (1 << 64)
        at = bisect_left(self.keys, key)
        if at == len(self.keys) or self.keys[at] != key:
            raise KeyError(word)
        if len(self) >= WORDS:
            self.clear()
        count = self[word] = self.counts[at]
        return count


def score_block(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """Sums the code lengths and word counts of the texts of a block."""
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "words": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
    key, value = entries["key"].to_numpy(), entries["value"].to_numpy()
    is_gram, is_word = (key >= 0) & (key != STOP), key < 0
    lookup = _Lookup(key[is_gram], value[is_gram])
    words, which = np.unique(key[is_word], return_inverse=True)
    count_of = _Counts(words, np.bincount(which, weights=value[is_word], minlength=len(words)).astype(np.float64))
    stop = float(value[key == STOP].astype(np.float64).sum())
    del entries, key, value, is_gram, is_word, words, which
    n_tokens, n_known, sums, scores = [], [], [], []
    for texts in _texts(docs["text"]):
        keys, starts = grams(texts)
        scores.append(np.add.reduceat(lookup.of(keys).astype(np.float64), starts))
        del keys
        for t in texts:
            w = t.lower().split()
            c = np.fromiter(map(count_of.__getitem__, w), dtype=np.float64, count=len(w))
            n_tokens.append(len(w) + 1)
            n_known.append(int((c > 0).sum()) + (stop > 0))
            sums.append(float(np.log10(c + 1).sum()) + math.log10(stop + 1))
    scores = np.concatenate(scores)
    del lookup, count_of
    pa.default_memory_pool().release_unused()
    return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "words": sums, "score": scores})


def _is_gram() -> Column:
    return (F.col("key") >= 0) & (F.col("key") != STOP)


def seen_lengths(counts: DataFrame) -> DataFrame:
    """(key, value) of the grams that training has seen, each once in ``counts`` (key, n):
    log10 of the probability of the symbol in its longest context."""
    context = Window.partitionBy(F.shiftright("key", _BITS))
    return counts.select("key", F.log10(F.col("n") / (F.sum("n").over(context) + F.count("*").over(context))).alias("value"))


def unseen_lengths(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with value: log10 of the probability of the symbol in its context for
    its key, which is none of the grams of ``counts`` (key, n; each once) and is reached
    by escapes. Tables of at most two symbols, 257 squared rows at any size, are
    broadcast; longer ones are exchanged once, by the gram without its first symbol:
    all counts that make up that of the shorter gram are then in one place."""
    table, contexts = {ORDER: counts.select(F.col("key").alias("g"), F.col("n").alias("c"))}, {}
    for k in range(ORDER, -1, -1):
        low, context = F.col("g").bitwiseAND(F.lit((1 << (_BITS * k)) - 1)), F.shiftright("g", _BITS).alias("context")
        met = table[k].repartition(low) if k > 2 else table[k]
        if k:
            table[k - 1] = met.groupBy(low.alias("low")).agg(F.sum("c").alias("c")).withColumnRenamed("low", "g")
        if k > 2:
            rows = met.select(context, "c", F.sum("c").over(Window.partitionBy(low)).alias("shared"))
        elif k:
            shorter = F.broadcast(table[k - 1].select(F.col("g").alias("low"), F.col("c").alias("shared")))
            rows = met.join(shorter, low == F.col("low")).select(context, "c", "shared")
        else:
            rows = met.select(context, "c", F.lit(0).cast("long").alias("shared"))
        contexts[k] = rows.groupBy("context").agg(F.sum("c").alias(f"n{k}"), F.count("*").alias(f"d{k}"), F.sum("shared").alias(f"m{k}"))
    columns = wanted.columns
    out = wanted.select(*columns, F.lit(0.0).alias("value"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("less_n"), F.lit(0).cast("long").alias("less_d"))
    for k in range(ORDER, -1, -1):
        gram = F.col("key").bitwiseAND(F.lit((1 << (_BITS * (k + 1))) - 1))
        out = out.join(F.broadcast(contexts[k]) if k <= 2 else contexts[k], F.shiftright(gram, _BITS) == F.col("context"), "left")
        if k < ORDER:
            out = out.join(F.broadcast(table[k]) if k <= 1 else table[k], gram == F.col("g"), "left")
        else:
            out = out.withColumn("c", F.lit(None).cast("long"))
        n, d = F.col(f"n{k}") - F.col("less_n"), F.col(f"d{k}") - F.col("less_d")
        gain = F.when(F.col("done") | F.col(f"n{k}").isNull(), 0.0).when(F.col("c").isNotNull(), F.log10(F.col("c") / (n + d))).when(d > 0, F.log10(d / (n + d))).otherwise(0.0)
        out = out.select(*columns, (F.col("value") + gain).alias("value"), (F.col("done") | F.col("c").isNotNull()).alias("done"), F.coalesce(f"m{k}", "less_n").alias("less_n"), F.coalesce(f"d{k}", "less_d").alias("less_d"))
    floor = -F.log10(F.lit(SYMBOLS) - F.col("less_d"))
    return out.select(*columns, (F.col("value") + F.when(F.col("done"), 0.0).otherwise(floor)).alias("value"))


def held_out() -> Column:
    """True for documents that the model doesn't learn from; a null doc_id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2


def score(docs: DataFrame, apart: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (word counts) and score (the byte model, the end of
    the text included), both log10.

    The model learns from the rows where ``apart`` is false and all rows are
    scored. Whole texts count; a null text is empty and has one symbol, its end.
    Without training rows all symbols are equally likely. Repeated rows stay; other
    columns of ``docs`` take no part.
    """
    rows = docs.select("doc_id", text_bytes().alias("text"), (held_out() if apart is None else apart).alias("held_out"))

    def counted(batch):
        yield _counted(batch["text"].to_pylist())

    learned = map_rows(rows.where(~F.col("held_out")).select("text"), counted, "key long not null, n long not null")
    counts = cut(learned.groupBy("key").agg(F.sum("n").alias("n")))
    known = counts.where(~_is_gram()).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    seen = counts.where(_is_gram())
    # A count of words that a float can't hold comes in two rows, which add up to it.
    near = F.col("n").cast("float").cast("double")
    words = counts.where(~_is_gram()).select("key", "n")
    values = seen_lengths(seen).union(words.select("key", near))
    values = values.union(words.where(F.col("n") > 1 << 24).select("key", F.col("n") - near))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).select("block", "doc_id", "held_out", "text")
    asked = dealt.groupBy("block").applyInArrow(keys_of_block, "block int not null, key long not null")
    # One exchange of the keys serves both branches: what sorts them out stands above the join.
    met = asked.join(values, "key", "left").select("block", "key", F.coalesce("value", F.when(_is_gram(), _UNSEEN).otherwise(0.0)).alias("value"))
    told = met.where(F.col("value") > _UNSEEN).union(unseen_lengths(seen, met.where(F.col("value") <= _UNSEEN).select("block", "key")))
    told = told.select("block", "key", F.col("value").cast("float").alias("value"))
    summed = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score_block, "doc_id long, held_out boolean, n_tokens long, n_known long, words double, score double")
    base = F.col("words") - F.col("n_tokens") * math.log10(known[0] + known[1] + 1)
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known[0]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
