import math
from collections import Counter

import numpy as np
import xxhash

from tideglass.llm import toxicity as T
from tideglass.llm.common import within


def slow_features(text):
    words = text.lower().encode().translate(T.PARTED).split()
    h = [xxhash.xxh64_intdigest(w, 0) for w in words]
    out = list(h) + [xxhash.xxh64_intdigest(w[:n], n) for n in T.HEADS for w in words]
    for gap in (1, 2, 3):
        out += [(a * 0x9E3779B97F4A7C15 + b * (2 * gap + 1)) * 0xC2B2AE3D27D4EB4F % 2**64 for a, b in zip(h, h[gap:])]
    return sorted(x >> 32 for x in out)


def test_features(texts):
    rows = ["", "one", "Two words", "Don't: stop-it, NOW!! (ok)", "é à ß ñ 日本 語", *list(texts.values())[:10]]
    keys, owner = T.hashed(rows)
    for k, t in enumerate(rows):
        assert sorted(keys[owner == k].tolist()) == slow_features(t)


def test_table_starts_anew():
    f = T.Families(most=3)
    first = f.hashes([[b"a", b"b"], [b"c", b"d", b"e"]])[0]
    again = f.hashes([[b"e", b"a"]])[0]
    assert len(f) == 2 and np.array_equal(again, first[[4, 0]])


def test_frequent():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 2**32, 50, dtype=np.uint64).astype(np.uint32) // np.uint32(1 << 26)) for _ in range(30)] + [np.zeros(0, np.uint32)]
    want = Counter(x for r in rows for x in r.tolist())
    for least in (1, 2, 5, 100):
        assert T._frequent(rows, least).tolist() == sorted(k for k, n in want.items() if n >= least)
    assert T._frequent([], 1).tolist() == []


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(2)
    m = T.Ftrl(1001)
    rows = [(rng.integers(0, 1000, 20), k % 3 == 0) for k in range(600)]
    for at, y in rows * 4:
        m.learn(np.append(np.unique(np.append(at[at > 1], 0 if y else 1)), 1000), float(y))
    w = m.weights()
    assert w[0] > 0 > w[1] and (w != 0).sum() < 500


def test_ftrl_update_by_definition():
    """Per coordinate: sigma = (sqrt(n + g^2) - sqrt(n)) / alpha, z += g - sigma w, n += g^2."""
    m, rng = T.Ftrl(12), np.random.default_rng(8)
    z, n = [0.0] * 12, [0.0] * 12
    for _ in range(200):
        at = np.unique(rng.integers(0, 12, 5))
        y = float(rng.integers(0, 2))
        w = {i: 0.0 if abs(z[i]) <= T.L1 else -(z[i] - math.copysign(T.L1, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2) for i in at.tolist()}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at.tolist():
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
        m.learn(at, y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_long_texts_are_bounded(spark):
    """Labelled documents of some megabytes: features beyond the bound are not read, and the model still learns."""
    rows = [(k, ("bad " if k % 2 else "good ") + " ".join(f"w{k}x{j}" for j in range(3000))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in T.score(docs, T.fit(docs, table, feature_bytes=1 << 20)).collect()}
    assert len(found) == 60
    made = spark.createDataFrame([(bytes([k]) * 1000,) for k in range(200)], "keys binary")
    assert 0 < within(made, "keys", 50_000).count() < 100 and within(made, "keys", 200_000).count() == 200
