import time

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tideglass.llm import components, simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows, radius=3):
    prints = [(i, slow_fingerprint(t or "")) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, f, least[find(k)]) for k, (i, f) in enumerate(prints))


def test_brute_force(docs, texts):
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(texts.items())


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(edge).collect())
    assert got == brute(rows)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.deduplicate(edge).columns == edge.columns


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in np.repeat(base, 8)]
    distinct = np.array(sorted({*map(int, base), *near, 0, 2**64 - 1}), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in distinct.view(np.int64)], "fp long")
    comp = {r.node % 2**64: r.component for r in components.components(simhash.links(table)).collect()}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if np.bitwise_count(a ^ b) <= 3:
                assert comp[int(a)] == comp[int(b)]
    seen = brute_parts(distinct)
    assert len({comp.get(int(x), int(x)) for x in distinct}) == seen


def brute_parts(values):
    left, n = set(map(int, values)), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            x = todo.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= 3}
            left -= near
            todo += near
    return n


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_crowded_buckets_lose_nothing(spark):
    """The second index against all pairs: few high bits vary, so every bucket is crowded at this bound."""
    rng = np.random.default_rng(9)
    low = rng.integers(0, 2**32, 150, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(k) for k in rng.choice(34, rng.integers(0, 5), replace=False)) for x in np.repeat(low, 4)]
    distinct = np.array(sorted({*map(int, low), *near}), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in distinct.view(np.int64)], "fp long")
    for rows in (table, table.select(F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)").alias("fp"))):
        values = np.array([r.fp for r in rows.collect()], np.int64).view(np.uint64)
        found = {(r.a, r.b) for r in simhash.links(rows, crowded=2).collect()}
        assert all(bin((a ^ b) % 2**64).count("1") <= 3 for a, b in found)
        comp = {r.node % 2**64: r.component for r in components.components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
        for i, a in enumerate(values):
            for b in values[:i]:
                if np.bitwise_count(a ^ b) <= 3:
                    assert comp[int(a)] == comp[int(b)]
        assert len({comp.get(int(x), int(x)) for x in values}) == brute_parts(values)


def test_one_bucket_of_200000(spark):
    """All fingerprints share their high segment; planted pairs are found, and the work does not grow with the square."""
    rng = np.random.default_rng(4)
    low = np.unique(rng.integers(0, 2**32, 200_000, dtype=np.uint64))
    pairs = [(int(x), int(x) ^ 0b10000000100000000000000100000000) for x in low[::2000]]
    values = np.unique(np.concatenate([low, np.array([b for _, b in pairs], np.uint64)])) | np.uint64(0xABCD << 40)
    table = spark.createDataFrame(pd.DataFrame({"fp": values.view(np.int64)}))
    began = time.time()
    found = {frozenset((r.a, r.b)) for r in simhash.links(table).collect()}
    assert time.time() - began < 120
    assert all(bin(a ^ b).count("1") <= 3 for a, b in map(tuple, found))
    comp = {x: k for k, part in enumerate(joined(found)) for x in part}
    high = 0xABCD << 40
    assert all(comp[a | high] == comp[b | high] for a, b in pairs)


def joined(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in map(tuple, links):
        root[find(a)] = find(b)
    parts = {}
    for x in list(root):
        parts.setdefault(find(x), set()).add(x)
    return list(parts.values())
