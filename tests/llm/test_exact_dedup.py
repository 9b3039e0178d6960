import hashlib
import re
from collections import defaultdict

from tideglass.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], h) for h, g in groups.items() for _, i in g)


def test_brute_force(docs, texts):
    got = sorted(map(tuple, exact_dedup.mark(docs).collect()))
    assert got == brute(texts.items())


def test_small_k_is_the_same(docs, texts):
    assert sorted(map(tuple, exact_dedup.mark(docs, k=3).collect())) == brute(texts.items())


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(map(tuple, exact_dedup.mark(edge).collect())) == brute(rows)
    assert exact_dedup.mark(empty).collect() == []
    kept = exact_dedup.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted({r.doc_id for r in kept.collect()}) == [2, 5, 6, 7, 8, 9, 10, 11, 12]


def test_heavy_hitters_found(spark):
    table = exact_dedup.digests(spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text"))
    found = exact_dedup.heavy_digests(table.repartition(6), k=8, fan_in=2)
    assert hashlib.sha256(b"hot").digest() in found and len(found) <= 8


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (None, "ab"), (None, "only here"), (2, "ab"), (2, "only there"), (3, "twice"), (3, "twice"), (3, "tw ice"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in exact_dedup.deduplicate(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, "a b"), (None, "only here"), (2, "only there"), (3, "tw ice"), (None, "")]))
