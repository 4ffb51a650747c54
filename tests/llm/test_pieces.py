import math
import random

import pytest

from sluice.llm import pieces

VOCABULARY = pieces.Vocabulary(
    tuple((p, i, s) for i, (p, s) in enumerate([("▁", -3.0), ("▁a", -2.0), ("ab", -2.5), ("abc", -2.7), ("bc", -2.1), ("c", -4.0), ("a", -4.2), ("b", -4.1), ("▁ab", -3.3), ("▁▁", -5.0), ("cab", -3.1), ("abcab", -9.0)])),
    tuple(range(100, 356)),
)


def best(vocabulary, text):
    """Score of the best segmentation by trying every piece at every place."""
    table = {p: s for p, _, s in vocabulary.pieces}
    unknown = min(table.values()) - 10
    top = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in table:
                top[end] = max(top[end], top[start] + table[piece])
        if text[end - 1] not in table:
            top[end] = max(top[end], top[end - 1] + unknown)
    return top[-1]


def cost(vocabulary, machine, text):
    score = {i: s for _, i, s in vocabulary.pieces}
    return sum(score[i] if i >= 0 else machine.unknown for _, i in machine.segment(text))


def test_segmentation_is_the_best_one():
    machine, draw = pieces.Automaton(VOCABULARY), random.Random(4)
    for _ in range(2000):
        text = "".join(draw.choice("▁abcx") for _ in range(draw.randint(0, 14)))
        assert cost(VOCABULARY, machine, text) == pytest.approx(best(VOCABULARY, text))
        whole = text.lstrip("▁")
        ids = machine.encode(whole.replace("▁", " "))
        spans = "▁" + whole if whole else ""
        by_id = {i: s for _, i, s in VOCABULARY.pieces}
        assert sum(by_id.get(i, machine.unknown) for i in ids) == pytest.approx(best(VOCABULARY, spans))


def test_public_vocabulary_is_segmented_best(docs):
    vocabulary = pieces.load()
    machine = pieces.automaton(vocabulary)
    table = {p: s for p, _, s in vocabulary.pieces}
    for text in [r["text"][:300] for r in docs.limit(12).collect()]:
        for stretch in pieces._STRETCH.findall("▁" + text.replace(" ", "▁"))[:40]:
            unknown = machine.unknown
            top = [0.0] + [-math.inf] * len(stretch)
            for end in range(1, len(stretch) + 1):
                for start in range(max(0, end - 16), end):
                    if stretch[start:end] in table:
                        top[end] = max(top[end], top[start] + table[stretch[start:end]])
                if stretch[end - 1] not in table:
                    top[end] = max(top[end], top[end - 1] + unknown)
            assert cost(vocabulary, machine, stretch) == pytest.approx(top[-1])


def test_round_trip_over_the_table(spark, docs):
    encoded = pieces.encode(docs)
    assert encoded.where("not exact").count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == texts


def test_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in pieces.encode(odd).collect()}
    assert pieces.encode(odd).count() == odd.count() and pieces.encode(none).count() == 0
    assert list(rows[1]["ids"]) == [] == list(rows[2]["ids"]) and rows[1]["exact"]
    assert not rows[8]["exact"] and rows[7]["exact"] and rows[3]["exact"]


def test_forgetting_changes_nothing(docs, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    machine = pieces.Automaton(pieces.load())
    other = pieces.automaton(pieces.load())
    for r in docs.limit(5).collect():
        assert machine.encode(r["text"][:2000]) == other.encode(r["text"][:2000])


def test_very_long_stretch(monkeypatch):
    machine, draw = pieces.Automaton(VOCABULARY), random.Random(8)
    text = "".join(draw.choice("abcx") for _ in range(30_000))
    long = machine.segment(text)
    monkeypatch.setattr(pieces, "LONG", 1 << 30)
    assert machine.segment(text) == long and cost(VOCABULARY, machine, text) == pytest.approx(best(VOCABULARY, text[:0]) + sum({i: s for _, i, s in VOCABULARY.pieces}.get(i, machine.unknown) for _, i in long))
    ids = machine.encode(text)
    assert machine.decode(ids) == text and not machine.remembered


def test_texts_together_are_segmented_as_one_by_one(docs, monkeypatch):
    draw, odd = random.Random(9), ["", "▁ mark \U0001f600 é \x00   x", "  ", "▁", " a ", "x" * 100 + " y", "語" * 60 + " 語", "a  b   a  b", "\n\n \t"]
    drawn = ["".join(draw.choice(" abcx\U0001f600▁") for _ in range(draw.randint(0, 90))) for _ in range(500)]
    for machine, texts in ((pieces.Automaton(VOCABULARY), drawn + odd), (pieces.Automaton(pieces.load()), odd + [r["text"] for r in docs.limit(30).collect()])):
        for together in (7, 1 << 13):
            monkeypatch.setattr(pieces, "TOGETHER", together)
            ids, offsets, exact = machine.encode_all(texts)
            one = [machine.encode(t) for t in texts]
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [list(i) for i in one]
            assert exact == [machine.decode(i) == t for i, t in zip(one, texts)]
        assert [x.tolist() for x in machine.encode_all(["", ""])[:2]] == [[], [0, 0, 0]]


def test_short_stretches_are_run_together_each_once(docs, monkeypatch):
    machine, texts = pieces.Automaton(pieces.load()), [r["text"] for r in docs.limit(30).collect()]
    run, seen = pieces._Tables.segment, []
    monkeypatch.setattr(pieces._Tables, "segment", lambda self, codes, begins, lengths: seen.append(len(lengths)) or run(self, codes, begins, lengths))
    machine.encode_all(texts)
    short = {s for t in texts for s in pieces._STRETCH.findall(f"▁{t.replace(' ', '▁')}") if len(s) <= pieces.SHORT}
    assert sum(seen) == len(short)


def test_groups_of_texts_agree(odd, monkeypatch):
    whole = sorted(map(repr, pieces.encode(odd).collect()))
    monkeypatch.setattr(pieces, "GROUP", 10)
    assert sorted(map(repr, pieces.encode(odd).collect())) == whole
