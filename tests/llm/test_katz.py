import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F
from tideglass.llm import katz
from tideglass.llm.common import crc_mod


def slow(rows, order=2, few=katz.FEW):
    """Dictionaries and the definition over all words, one token after the other."""
    toks = [(i, bool(h), [*(t or "").encode().lower().split(), b""]) for i, t, h in rows]
    grams = {j: Counter() for j in range(1, order + 1)}
    for _, h, ws in toks:
        if not h:
            line = [b""] * (order - 1) + ws
            for k in range(order - 1, len(line)):
                for j in grams:
                    grams[j][tuple(line[k - j + 1 : k + 1])] += 1
    d = {j: katz.discounts(Counter(c.values()), few) for j, c in grams.items()}
    kept = {j: {g: n * (d[j][n] if n <= few else 1.0) for g, n in c.items()} for j, c in grams.items()}
    total = sum(grams[1].values())
    mass = max(total + (0.5 if total - sum(kept[1].values()) < 1e-9 else 0), 0.5)
    after = {j: defaultdict(list) for j in grams}
    for j, c in grams.items():
        for g in c:
            after[j][g[:-1]].append(g)
    seen = {}

    def weights(h):
        if h not in seen:
            of = after[len(h) + 1][h]
            n, left = sum(grams[len(h) + 1][g] for g in of), sum(kept[len(h) + 1][g] for g in of)
            full = n + (0.5 if n - left < 1e-9 else 0)
            seen[h] = (full, (1 - left / full) / (1 - sum(p(g[-1], h[1:]) for g in of)))
        return seen[h]

    def p(w, h):
        if not h:
            return kept[1][(w,)] / mass if (w,) in kept[1] else 1 - sum(kept[1].values()) / mass
        if h not in after[len(h) + 1]:
            return p(w, h[1:])
        if (*h, w) in grams[len(h) + 1]:
            return kept[len(h) + 1][(*h, w)] / weights(h)[0]
        return weights(h)[1] * p(w, h[1:])

    out = []
    for i, h, ws in toks:
        line = [b""] * (order - 1) + ws
        s = sum(math.log10(p(w, tuple(line[k : k + order - 1]))) for k, w in enumerate(ws))
        base = sum(math.log10((grams[1][(w,)] + 0.5) / (total + 0.5 * (len(grams[1]) + 1))) for w in ws)
        out.append((i, h, len(ws), sum((w,) in grams[1] for w in ws), total, base, s))
    return out, p, [w for w, in grams[1]], after


def held(i, n=5, at=1):
    return i is not None and zlib.crc32(str(i).encode()) % n == at


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize(("order", "hot_words", "hot"), [(2, katz.HOT_WORDS, katz.HOT), (2, 200, 30), (2, 0, 0), (3, 300, 50), (3, katz.HOT_WORDS, katz.HOT)])
def test_brute_force(docs, texts, order, hot_words, hot):
    """The whole vocabulary; the caches' sizes change nothing."""
    want, *_ = slow([(i, t, held(i)) for i, t in texts.items()], order)
    same(katz.katz_scores(docs, crc_mod("doc_id", 5) == 1, order=order, hot_words=hot_words, hot=hot).collect(), want)


def test_four_words(spark):
    rows = [(k, " ".join("abcde"[(k * 7 + m * m) % 5] for m in range(k % 9)), held(k)) for k in range(60)]
    want, *_ = slow(rows, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    same(katz.katz_scores(docs, crc_mod("doc_id", 5) == 1, order=4, hot_words=3, hot=4).collect(), want)


@pytest.mark.parametrize("order", [2, 3])
def test_sums_to_one(texts, order):
    """All words and the unseen one, after histories that were seen and that were not."""
    _, p, words, after = slow([(i, t, held(i)) for i, t in texts.items()], order)
    for h in [*list(after[order])[:8], *list(after[order])[-4:], (b"never", b"seen")[: order - 1]]:
        assert abs(sum(p(w, h) for w in words) + p(b"not a word", h) - 1) < 1e-9


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text, held(r.doc_id)) for r in edge.collect()]
    for order in (2, 3):
        want, *_ = slow(rows, order)
        same(katz.katz_scores(edge, crc_mod("doc_id", 5) == 1, order=order, hot_words=5, hot=3).collect(), want)
        assert katz.katz_scores(empty, crc_mod("doc_id", 5) == 1, order=order).collect() == []
    none = katz.katz_scores(edge, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) and r.n_known == 0 for r in none)


def test_better_than_the_base(docs):
    rows = katz.katz_scores(docs, crc_mod("doc_id", 5) == 1).collect()
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
