"""The quality classifier's parts against plain loops over their definition."""

import math
from collections import Counter

import numpy as np
import xxhash

from tideglass.llm import quality as Q


def slow_structure(text: bytes) -> list[float]:
    chars = [chr(b) for b in text]
    kind = lambda b: "wide" if b >= 128 else "blank" if chr(b).isspace() else "digit" if chr(b).isdigit() else "upper" if chr(b).isupper() else "lower" if chr(b).islower() else "mark" if chr(b).isprintable() else "other"
    kinds = [kind(b) for b in text]
    n, of = len(text), Counter(kinds)
    words = text.lower().split()
    hashed = Counter(xxhash.xxh64_intdigest(w) % Q.WORDS for w in words)
    blank = lambda k: not 0 <= k < n or kinds[k] == "blank"
    run = sum(kinds[k] == "mark" and chars[k] == chars[k + 1] for k in range(n - 1))
    lone = sum(kinds[k] == "mark" and blank(k - 1) and blank(k + 1) for k in range(n))
    lines = [x for x in text.split(b"\n") if x]
    letters, size, count = max(1, of["lower"] + of["upper"] + of["wide"]), max(1, n), max(1, len(words))
    return [
        math.log1p(n), math.log1p(len(words)), n / count, len(hashed) / count, of["upper"] / letters, of["digit"] / size, of["mark"] / size, run / size, lone / count,
        text.count(b"\n") / size, 1 - len(set(lines)) / len(lines) if lines else 0.0, sum(a == b for a, b in zip(words, words[1:])) / count, of["wide"] / size, max(hashed.values(), default=0) / count,
    ]


def test_features_and_statistics(texts):
    rows = [b"a", "One two, TWO two!! 12 é 日本\n\nsame\nsame\n".encode(), b"", b" \t\n", b"x - y ... !? \x01", *[t.encode() for t in list(texts.values())[:40]]]
    keys, sizes, stats = Q.features(rows)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for k, t in enumerate(rows):
        assert keys[cuts[k] : cuts[k + 1]].tolist() == sorted({xxhash.xxh64_intdigest(w) % Q.WORDS for w in t.lower().split()})
        assert np.allclose(stats[k], slow_structure(t)), (t, list(zip(Q.NAMES, stats[k], slow_structure(t))))


def slow_margin(m, feats):
    pairs = sum(float(m.v[i] @ m.v[j]) * a * b for x, (i, a) in enumerate(feats) for j, b in feats[:x])
    return m.w0 + sum(float(m.w[i]) * a for i, a in feats) + pairs


def slow_feats(m, keys, stats):
    out = [(int(k), 1 / math.sqrt(max(1, len(keys)))) for k in keys]
    return out + [(m.words + s * m.bins + int(sum(x >= e for e in m.edges[s])), 1.0) for s, x in enumerate(stats)]


def test_score_is_the_sum_over_pairs(spark, edge, texts):
    rows = [t.encode() for t in list(texts.values())[:60]]
    keys, sizes, stats = Q.features(rows)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    parts = [keys[a:b] for a, b in zip(cuts, cuts[1:])]
    m = Q.fit_machine(parts, stats, np.array([float(k % 3 == 0) for k in range(60)]), epochs=2)
    got = {r.doc_id: r.score for r in Q.score(edge, m).collect()}
    for r in edge.select("doc_id", "text").collect():
        k, s, st = Q.features([(r.text or "").encode()])
        z = slow_margin(m, slow_feats(m, k, st[0]))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-4


def test_one_step_follows_the_gradient():
    """The first step moves every touched coordinate against the numerical gradient of the logistic loss."""
    rng = np.random.default_rng(3)
    keys = [np.unique(rng.integers(0, 30, 6)) for _ in range(8)]
    stats, label = rng.random((8, len(Q.NAMES))), np.array([1.0, 0, 1, 1, 0, 0, 1, 0])
    how = dict(words=30, bins=3, factors=2, decay=0.0, together=8)
    m, after = (Q.fit_machine(keys, stats, label, epochs=e, **how) for e in (0, 1))
    m.v = m.v.astype(float)
    feats = [slow_feats(m, k, s) for k, s in zip(keys, stats)]
    loss = lambda: float(np.mean([math.log1p(math.exp(-z if y else z)) for z, y in ((slow_margin(m, f), y) for f, y in zip(feats, label))]))
    for table, new, rate in ((m.w, after.w, 0.1), (m.v, after.v, 0.03)):
        moved = 0
        for at in np.ndindex(table.shape):
            kept, step = float(table[at]), 1e-3
            table[at] = kept + step
            high = loss()
            table[at] = kept - step
            low = loss()
            table[at] = kept
            slope = (high - low) / (2 * step)
            if abs(slope) > 1e-3:
                want = kept - rate * slope / math.sqrt(slope * slope + 1e-6)
                assert abs(float(new[at]) - want) < 2e-3, (at, slope)
                moved += 1
        assert moved > 10
