import hashlib
import random

from tideglass.llm import chunks


def slow_ends(x):
    """One byte after another."""
    ends, cut, h = [], 0, 0
    for k, b in enumerate(x):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        n = k + 1 - cut
        mask = int(chunks.STRICT if n <= chunks.NORMAL else chunks.LOOSE)
        if n >= chunks.LEAST and len(x) - cut > chunks.LEAST and h & mask == 0 or n == chunks.MOST:
            ends.append(k + 1)
            cut = k + 1
    return ends if not x or ends and ends[-1] == len(x) else [*ends, len(x)]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        a, b, c = chunks.chunk_sets([t.encode(), new.encode(), following.encode()])
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), chunks.written_out(a), chunks.written_out(b), chunks.likeness(a, b), chunks.likeness(a, c)))
    return sorted(out)


def test_boundaries_are_sequential():
    r = random.Random(3)
    texts = [bytes(r.randrange(97, 105) for _ in range(n)) for n in [0, 1, 11, 12, 13, 39, 40, 41, 160, 161, 500, 3000]] + [b"a" * 1000]
    assert list(chunks.boundaries(texts)) == [slow_ends(x) for x in texts]


def test_brute_force(docs, texts):
    assert sorted(map(tuple, chunks.with_neighbours(docs).collect())) == brute(texts.items())


def test_edges(edge, empty, spark):
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    assert sorted(map(tuple, chunks.with_neighbours(edge).collect())) == brute(rows)
    assert chunks.with_neighbours(empty).collect() == []
    one = spark.createDataFrame([(5, "some text of its own that follows itself")], "doc_id long, text string")
    assert chunks.with_neighbours(one).first().near_next == 1.0
    same = spark.createDataFrame([(7, f"text {k % 3}") for k in range(50)] + [(None, "no id")], "doc_id long, text string")
    assert chunks.with_neighbours(same.repartition(5)).count() == 51


def test_likeness(docs, texts):
    rows = [r for r in chunks.with_neighbours(docs).collect() if r.n_chars >= 200]
    assert all(0 <= r.near_edited <= 1 for r in rows)
    assert sum(r.near_edited for r in rows) / len(rows) > 0.4
    assert sum(r.near_next for r in rows) / len(rows) < 0.1
    assert chunks.read_in(rows[0].fingerprint) == chunks.chunk_sets([texts[rows[0].doc_id].encode()])[0]
    assert {r.doc_id: r.fingerprint for r in chunks.fingerprints(docs).collect()}[rows[0].doc_id] == rows[0].fingerprint
