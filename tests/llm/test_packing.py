import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tideglass.llm import packing


def slow_pieces(rows, capacity=2048):
    t = Tokenizer.from_file(packing.default_tokenizer())
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def check_places(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_brute_force(docs, texts):
    rows = packing.pack(docs, packing.default_tokenizer()).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == slow_pieces(texts.items())
    used = check_places(rows)
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_edges(edge, empty):
    rows = packing.pack(edge, packing.default_tokenizer(), with_ids=True).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == slow_pieces([(r.doc_id, r.text) for r in edge.collect()])
    check_places(rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(empty, packing.default_tokenizer()).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_all(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 30, 100])
    counts = Counter(r.randint(1, capacity) for _ in range(r.randint(1, 200)))
    patterns = packing.plan(counts, capacity)
    placed = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(x * n for x, n in pattern) <= capacity
        for x, n in pattern:
            placed[x] += n * times
    assert placed == counts


def fewest(items, capacity):
    """Exact, by depth-first search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {room: i for i, room in enumerate(rooms) if room >= items[k]}.values():
            go(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(120))
def test_dominance_keeps_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 15, 20])
    counts = Counter(r.randint(1 if seed % 2 else capacity // 4, capacity) for _ in range(9))
    fixed, left = packing.dominance(counts, capacity)
    rest = fewest(Counter(left).elements(), capacity) if left else 0
    assert sum(n for _, n in fixed) + rest == fewest(counts.elements(), capacity)


def test_plan_does_not_walk_items():
    """The plan's size follows the lengths, not the pieces."""
    counts = {n: 10**9 + n for n in (3, 300, 600, 682, 700, 1024, 1500, 2045, 2048)}
    patterns = packing.plan(counts, 2048)
    assert len(patterns) < 100
    assert sum(times for _, times in patterns) <= 1.05 * sum(n * c for n, c in counts.items()) / 2048


ADDED = ["a <|startoftext|> b", "x<|endoftext|>.y <|endoftext|", "A <|StartOfText|> <|ENDOFTEXT|>", "<|endoftext|><|startoftext|>", "don<|endoftext|>'t\u0301 <|endoftext|> \u0301e", "plain <| startoftext |> text"]


def test_added_tokens_as_the_library_has_them():
    """The library as its file sets it up; a text may hold its added tokens."""
    plain = Tokenizer.from_file(packing.default_tokenizer())
    words = packing.WordTokens(packing.default_tokenizer())
    assert words.by_word
    for text in ADDED:
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 49406 in np.frombuffer(words.ids(ADDED[0].encode()), "<u4") and 49407 in np.frombuffer(words.ids(ADDED[1].encode()), "<u4")


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = packing.WordTokens(path), Tokenizer.from_file(path)
    text = "  Two  words,\n\tand <|endoftext|> more "
    assert not words.by_word and np.frombuffer(words.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
