"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a text once. At every character it stands on
the longest piece suffix, and its output links lead to all shorter ones; each
relaxes the best score of a segmentation that ends there. A character that no
piece covers falls back to its UTF-8 bytes. No piece holds a space mark behind
another character, so segmentations of the stretches between spaces are
independent. Over a batch of texts each distinct stretch is segmented once, and
the automaton runs over all short ones together, a character of each at a time.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from dataclasses import dataclass
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_rows, text_bytes

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches of a generation, their length at most. A worker remembers two: at this
#: many the newer becomes the older one, whose stretches come back as they are met.
#: Neither changes a result.
REMEMBERED, SHORT = 80_000, 48
#: From this length on the table of a stretch is held in 16 bytes a character.
LONG = 1 << 12
#: Bytes of texts whose stretches are told apart together, about, and stretches
#: that the automaton runs over together.
GROUP, TOGETHER = 8 << 20, 1 << 13
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (piece, id, score) of ordinary pieces; byte_ids: id of each byte."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Reads a vocabulary file; only its pieces and scores are used."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    by_piece = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    if len(by_piece) != 256:
        raise ValueError("the vocabulary has no byte pieces to fall back to")
    pieces = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in plain)
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError("a piece crosses a space")
    return Vocabulary(pieces, tuple(by_piece[f"<0x{b:02X}>"] for b in range(256)))


class Automaton:
    """Goto, failure and output links over the pieces of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.next: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]
        for text, id_, score in vocabulary.pieces:
            at = 0
            for ch in text:
                to = self.next[at].get(ch)
                if to is None:
                    to = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.piece.append(None)
                at = to
            self.piece[at] = (len(text), id_, score)
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            at = waiting.popleft()
            for ch, to in self.next[at].items():
                back = self.fail[at]
                while back and ch not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(ch, 0)
                waiting.append(to)
            #: The nearest state on the failure path that ends a piece.
            back = self.fail[at]
            self.output[at] = back if self.piece[back] else self.output[back]
        self.byte_ids = vocabulary.byte_ids
        self.unknown = min(s for _, _, s in vocabulary.pieces if s > -1e8) - 10.0 if vocabulary.pieces else -10.0
        self.bytes_of = {i: t.replace(SPACE, " ").encode() for t, i, _ in vocabulary.pieces} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.ends: list[tuple | None] = [None] * len(self.next)
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tables: _Tables | None = None

    def outputs(self, at: int) -> tuple[tuple[int, int, float], ...]:
        """(-length, id, score) of the pieces that end in a state, longest first: its own
        and, over the output links, all shorter ones. Followed once for each state."""
        found = self.ends[at]
        if found is None:
            own = ()
            if self.piece[at]:
                length, id_, score = self.piece[at]
                own = ((-length, id_, score),)
            found = self.ends[at] = own + (self.outputs(self.output[at]) if self.output[at] else ())
        return found

    def segment(self, text: str) -> list[tuple[int, int]]:
        """(start, id) of the best segmentation, id -1 for a character without a
        piece. Of equal scores the longer last piece wins."""
        table = (lambda kind, first: array(kind, [first])) if len(text) >= LONG else (lambda _kind, first: [first])
        best, start, taken = table("d", 0.0), table("q", 0), table("i", -1)
        next_, fail, ends, unknown = self.next, self.fail, self.ends, self.unknown
        at = 0
        for end, ch in enumerate(text, 1):
            to = next_[at].get(ch)
            while to is None and at:
                at = fail[at]
                to = next_[at].get(ch)
            at = to or 0
            top, back, id_, length = -inf, -1, -1, 0
            found = ends[at]
            # best ends at the character before this one; lengths are negative.
            for length, piece, score in self.outputs(at) if found is None else found:
                total = best[length] + score
                if total > top:
                    top, back, id_ = total, length, piece
            if length != -1 and best[-1] + unknown > top:
                top, back, id_ = best[-1] + unknown, -1, -1
            best.append(top)
            start.append(end + back)
            taken.append(id_)
        path, end = [], len(text)
        while end:
            path.append((start[end], taken[end]))
            end = start[end]
        return path[::-1]

    def stretch(self, text: str) -> bytes:
        """Ids of one stretch, four bytes each; short ones are remembered."""
        if len(text) > SHORT:
            return self._ids(text).tobytes()
        ids = self.remembered.get(text)
        if ids is None:
            ids = self.older.get(text) or self._ids(text).tobytes()
            if len(self.remembered) >= REMEMBERED:
                self.remembered, self.older = {}, self.remembered
            self.remembered[text] = ids
        return ids

    def _ids(self, text: str) -> array:
        ids = array("i")
        for start, id_ in self.segment(text):
            if id_ >= 0:
                ids.append(id_)
            else:
                ids.extend(self.byte_ids[b] for b in text[start].encode())
        return ids

    def encode(self, text: str) -> array:
        ids = array("i")
        if text:
            known, stretch = self.remembered.get, self.stretch
            ids.frombytes(b"".join([known(part) or stretch(part) for part in _STRETCH.findall(SPACE + text.replace(" ", SPACE))]))
        return ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """(ids, offsets, exact) of many texts: the ids of encode() one text after the
        other, where each text begins and ends, and whether decoding gives it back."""
        marked = [b" " + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        data, begins = b"".join(marked), np.concatenate(([0], np.cumsum([len(m) for m in marked], dtype=np.int64)))
        if not data:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), [True] * len(texts)
        space = np.frombuffer(data, np.uint8) == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[begins[:-1][begins[:-1] < begins[1:]]] = True
        at = np.flatnonzero(first)
        stretches = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        which, distinct = stretches.indices.to_numpy(), stretches.dictionary
        ids, starts, good = self._ids_of(distinct)
        sizes = (starts[1:] - starts[:-1])[which]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(starts[which] - ends + sizes, sizes) + np.arange(ends[-1])]
        of_text = np.searchsorted(at, begins)
        bad = np.concatenate(([0], np.cumsum(~good[which])))[of_text]
        exact = [SPACE not in t and not b for t, b in zip(texts, np.diff(bad).tolist(), strict=True)]
        return flat, np.concatenate(([0], ends))[of_text], exact

    def _ids_of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, good) of stretches in UTF-8, with spaces as marks: their ids, where
        those of each begin, and whether decoding gives the stretch back."""
        if self.tables is None:
            self.tables = _Tables(self)
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        raw = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        text = raw.tobytes().decode()
        byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        char_at = np.searchsorted(byte_at, offsets)
        lengths = np.diff(char_at)
        codes = self.tables.code_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        order = np.argsort(-lengths, kind="stable")
        n_long = int((lengths > SHORT).sum())
        of, starts, taken = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in order[:n_long].tolist():
            path = np.array(self.segment(text[char_at[i] : char_at[i + 1]].replace(" ", SPACE)), dtype=np.int64)
            of.append(np.full(len(path), i))
            starts.append(path[:, 0] + char_at[i])
            taken.append(path[:, 1])
        for low in range(n_long, len(order), TOGETHER):
            some = order[low : low + TOGETHER]
            word, start, id_ = self.tables.segment(codes, char_at[some], lengths[some])
            of.append(some[word])
            starts.append(start)
            taken.append(id_)
        of, starts, taken = np.concatenate(of), np.concatenate(starts), np.concatenate(taken)
        # Every character is the start of one token at most.
        at = np.full(len(codes), -2, dtype=np.int64)
        at[starts] = taken
        starts = np.flatnonzero(at != -2)
        taken = at[starts]
        # A character without a piece takes as many ids as it has bytes.
        sizes = np.where(taken >= 0, 1, byte_at[starts + 1] - byte_at[starts])
        ends = np.cumsum(sizes)
        ids = np.repeat(taken, sizes)
        byte = np.flatnonzero(ids < 0)
        token = np.repeat(np.arange(len(sizes)), sizes)[byte]
        ids[byte] = self.tables.byte_ids[raw[byte_at[starts[token]] + byte - (ends - sizes)[token]]]
        first = np.concatenate(([0], ends))[np.searchsorted(starts, char_at)]
        back = self.tables.bytes_of.take(pa.array(ids))
        back_at = np.frombuffer(back.buffers()[1], np.int64)[back.offset : back.offset + len(back) + 1][first]
        whole = np.frombuffer(back.buffers()[2], np.uint8)[back_at[0] : back_at[-1]]
        good = np.diff(back_at) == np.diff(offsets)
        if not good.all() or not np.array_equal(whole, raw):
            parts = zip(offsets, offsets[1:], back_at - back_at[0], back_at[1:] - back_at[0], strict=False)
            good = np.array([np.array_equal(raw[a:b], whole[c:d]) for a, b, c, d in parts], dtype=bool)
        return ids.astype(np.int32), first, good

    def decode(self, ids) -> str:
        """The text of ids from encode(); a space mark in a text comes back as a space."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


class _Tables:
    """An automaton as arrays, to run over many stretches together. Characters are
    codes, 0 for one that is in no piece; a goto is found by a hash of state and code."""

    def __init__(self, machine: Automaton):
        chars = sorted({ch for goto in machine.next for ch in goto})
        self.code_of = np.zeros(0x110000, dtype=np.int64)
        self.code_of[[ord(ch) for ch in chars]] = np.arange(1, len(chars) + 1)
        self.code_of[0x20] = self.code_of[ord(SPACE)]
        code = {ch: i for i, ch in enumerate(chars, 1)}
        self.codes = len(chars) + 1
        self.root = np.zeros(self.codes, dtype=np.int64)
        for ch, to in machine.next[0].items():
            self.root[code[ch]] = to
        keys = np.array([at * self.codes + code[ch] for at, goto in enumerate(machine.next) for ch in goto], dtype=np.int64)
        self._hashed(keys, np.array([to for goto in machine.next for to in goto.values()], dtype=np.int64))
        self.fail, self.unknown = np.array(machine.fail, dtype=np.int64), machine.unknown
        outputs = [machine.outputs(at) for at in range(len(machine.next))]
        self.n_out = np.array([len(o) for o in outputs], dtype=np.int64)
        self.out_at = np.cumsum(self.n_out) - self.n_out
        self.out_length = np.array([-length for o in outputs for length, _, _ in o], dtype=np.int64)
        self.out_id = np.array([id_ for o in outputs for _, id_, _ in o], dtype=np.int64)
        self.out_score = np.array([score for o in outputs for _, _, score in o])
        self.single = np.array([bool(o) and o[-1][0] == -1 for o in outputs], dtype=bool)
        self.byte_ids = np.array(machine.byte_ids, dtype=np.int64)
        self.bytes_of = pa.array([machine.bytes_of.get(i, b"") for i in range(max(machine.bytes_of) + 1)], pa.large_binary())

    def _hashed(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Each key goes to the first free slot from its own on; of two that want one, the
        last that is written has it."""
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.to = np.full(self.mask + 1, -1, dtype=np.int64), np.zeros(self.mask + 1, dtype=np.int64)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            self.keys[slots[free]], self.to[slots[free]] = keys[free], to[free]
            left = np.flatnonzero(self.keys[slots] != keys)
            keys, to, slots = keys[left], to[left], (slots[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def goto(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        keys = state * self.codes + code
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.to[slots], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            found[left[hit]] = self.to[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return found

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character each, over failure links where needed."""
        out = self.root[code]
        left = np.flatnonzero((state > 0) & (code > 0))
        at, code = state[left], code[left]
        while len(left):
            to = self.goto(at, code)
            out[left[to >= 0]] = to[to >= 0]
            at = self.fail[at]
            more = np.flatnonzero((to < 0) & (at > 0))
            left, at, code = left[more], at[more], code[more]
        return out

    def segment(self, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, start, id) of the tokens of the best segmentations, as
        Automaton.segment() has them; stretches come longest first."""
        n, most = len(lengths), int(lengths[0])
        best, back, taken = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int64), np.zeros((most + 1, n), np.int64)
        flat, state = best.reshape(-1), np.zeros(n, dtype=np.int64)
        alive = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")
        for end in range(1, most + 1):
            m = int(alive[end - 1])
            state = self.step(state[:m], codes[begins[:m] + end - 1])
            top, length, id_ = np.full(m, -inf), np.ones(m, np.int64), np.full(m, -1, np.int64)
            some, j = np.flatnonzero(self.n_out[state]), 0
            while len(some):
                out = self.out_at[state[some]] + j
                total = flat[(end - self.out_length[out]) * n + some] + self.out_score[out]
                better = total > top[some]
                to, out = some[better], out[better]
                top[to], length[to], id_[to] = total[better], self.out_length[out], self.out_id[out]
                j += 1
                some = some[self.n_out[state[some]] > j]
            other = best[end - 1, :m] + self.unknown
            lone = np.flatnonzero(~self.single[state] & (other > top))
            top[lone], length[lone], id_[lone] = other[lone], 1, -1
            best[end, :m], back[end, :m], taken[end, :m] = top, length, id_
        words, starts, ids = [], [], []
        word, end = np.arange(n), lengths.copy()
        while len(word):
            ids.append(taken[end, word])
            end = end - back[end, word]
            words.append(word)
            starts.append(begins[word] + end)
            more = np.flatnonzero(end)
            word, end = word[more], end[more]
        return np.concatenate(words), np.concatenate(starts), np.concatenate(ids)


@lru_cache(maxsize=2)
def automaton(vocabulary: Vocabulary) -> Automaton:
    return Automaton(vocabulary)


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, ids array<int>, n_ids, exact) for each row of ``docs``: the best
    segmentation of the whole text, and whether decoding gives the text back.

    A null or empty text has no ids. A text that holds the space mark itself
    comes back with a space in its place (exact is false). Repeated rows stay.
    """
    vocabulary, group = load(model), GROUP

    def each(batch):
        coder = automaton(vocabulary)
        sizes, at = pc.binary_length(batch["text"]).to_pylist(), 0
        while at < len(sizes):
            end, size = at + 1, sizes[at]
            while end < len(sizes) and size + sizes[end] <= group:
                size += sizes[end]
                end += 1
            ids, offsets, exact = coder.encode_all([raw.decode("utf-8", "replace") for raw in batch["text"][at:end].to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield batch["doc_id"][at:end], lists, np.diff(offsets), exact
            at = end

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), each, "doc_id long, ids array<int>, n_ids int, exact boolean")


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    vocabulary = load(model)

    def each(batch):
        coder = automaton(vocabulary)
        yield batch["doc_id"], [coder.decode(ids.as_py() or []) for ids in batch["ids"]]

    return map_rows(encoded.select("doc_id", "ids"), each, "doc_id long, text string")
