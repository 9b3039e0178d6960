import heapq
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm import pieces as P

SP = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
MODEL = P.Pieces(P.default_model(), most=5000)


def ids(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in MODEL.encode(texts)]


def test_same_as_the_library(texts):
    rows = list(texts.values())
    assert ids(rows) == SP.encode(rows)
    for t, got in zip(rows, ids(rows), strict=True):
        assert MODEL.decode(got) == SP.decode(got) == t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_characters="\0"), st.sampled_from(" abcdet \n▁"))), min_size=1, max_size=5))
def test_any_text(rows):
    assert ids(rows) == SP.encode(rows)
    assert [MODEL.decode(x) for x in ids(rows)] == [SP.decode(x) for x in SP.encode(rows)]


def test_long_units_merge_alike():
    r = random.Random(1)
    rows = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (47, 48, 49, 400)] + [" " * 70 + "x", "a" * 300, "ab " * 100, "日本" * 60, "é" * 47]
    assert ids(rows) == SP.encode(rows)


@pytest.mark.parametrize("values", [[5, 300, 10], [0, 1, 2], [200, 201], [264, 259, 13]])
def test_decode_of_any_ids(values):
    assert MODEL.decode(values) == SP.decode(values)


def test_operators(edge, empty):
    rows = {r.doc_id: r.text or "" for r in edge.collect()}
    coded = P.encode(edge, P.default_model())
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: SP.encode(t) for i, t in rows.items()}
    assert {r.doc_id: r.text for r in P.decode(coded, P.default_model()).collect()} == rows
    assert P.encode(empty, P.default_model()).collect() == []


def test_query(spark, sf_dir, texts):
    got = {r.doc_id: r for r in P.op4_sentencepiece(spark, sf_dir).collect()}
    assert set(got) == set(texts) and all(r.round_trip for r in got.values())
    for i, t in texts.items():
        assert got[i].ids_crc32 == zlib.crc32(np.array(SP.encode(t), "<i4").tobytes())


def heap_merges(m, text):
    """The same segmentation, one merge at a time, by a heap: a form of its own to compare with."""
    parts = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = []

    def offer(a):
        if 0 <= a and after[a] < len(parts) and (i := m.id_of.get(parts[a] + parts[after[a]])) is not None:
            heapq.heappush(heap, (int(m.rank[i]), a, parts[a] + parts[after[a]]))

    for a in range(len(parts) - 1):
        offer(a)
    while heap:
        _, a, both = heapq.heappop(heap)
        if parts[a] is None or after[a] >= len(parts) or parts[a] + parts[after[a]] != both:
            continue
        gone = after[a]
        parts[a], parts[gone], after[a] = both, None, after[gone]
        if after[gone] < len(parts):
            before[after[gone]] = a
        offer(before[a])
        offer(a)
    return [i for p in parts if p is not None for i in m.spelt(p)]


@pytest.mark.parametrize("seed", range(6))
def test_long_units_as_by_heap_and_library(seed, monkeypatch):
    """Units longer than a suffix array, here of 70 characters: blocks overlap, merging goes over all."""
    monkeypatch.setattr(P, "TOGETHER", 70)
    r = random.Random(seed)
    words = ["information", "the", "nation", "ing", "tion", "a", "aa", "aaa", "日本語", "é", "http://www.", "0123", "\x01"]
    text = "".join(r.choice(words) for _ in range(200))
    unit = P.SIGN + text
    own = P.Pieces(P.default_model())
    got = np.frombuffer(own.encode([text])[0], "<i4").tolist()
    assert got == heap_merges(own, unit) == SP.encode(text)


def test_unit_of_400000_characters():
    text = "thequickbrownfoxjumpsoverthelazydog" * 11_500
    own = P.Pieces(P.default_model())
    got = np.frombuffer(own.encode([text])[0], "<i4").tolist()
    assert got == SP.encode(text)


def test_nul_in_a_text():
    """A NUL is a character without a piece: one byte."""
    own = P.Pieces(P.default_model())
    got = np.frombuffer(own.encode(["ab\0cd the\0"])[0], "<i4").tolist()
    assert own.decode(got) == "ab\0cd the\0" and got == [i for u in (P.SIGN + "ab\0cd", P.SIGN + "the\0") for i in heap_merges(own, u)]
