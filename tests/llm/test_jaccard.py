import random
from collections import Counter

import corpus_pipeline as C
import pyarrow as pa
import pytest
from tideglass.llm import jaccard


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def planted():
    """60 texts, each with copies that have one to eight words changed."""
    rng, rows = random.Random(7), []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for changed in (0, 1, 2, 4, 8):
            now = list(words)
            for _ in range(changed):
                now[rng.randrange(len(now))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(now)))
    return rows


def expected(rows):
    """The smallest id of each part that pairs of 0.8 or more connect."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if alike(rows[a][1], rows[b][1]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({rows[find(k)][0] for k in range(len(rows))})


def test_planted_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.deduplicate(docs).collect()) == expected(rows)


def test_stage_leaves_no_near_copies(spark, sf_dir):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.text for r in C.near_stage(spark, docs, sf_dir).collect()]
    assert len(kept) >= 60 and all(alike(a, b) < 0.8 for k, a in enumerate(kept) for b in kept[:k])


def test_large_group(spark):
    """Copies of one text whose neighbours are often under 0.8 from each other are still connected."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(300):
        now = list(words)
        for _ in range(5):
            now[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(now)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.deduplicate(docs).collect()) == expected(rows)


def test_edges(spark, edge, empty):
    rows = sorted(r.doc_id for r in jaccard.deduplicate(edge).collect())
    assert rows == [1, 3, 6, 7, 7, 8, 9, 11, 12]
    assert jaccard.deduplicate(edge).columns == edge.columns and jaccard.deduplicate(empty).collect() == []
    near = " ".join(f"w{k}" for k in range(100))
    odd = spark.createDataFrame([(None, near + " end"), (5, near), (5, "another text that nothing is like"), (None, "a third that stays")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in jaccard.deduplicate(odd).collect()} == {(5, near), (5, "another text that nothing is like"), (None, "a third that stays")}


def test_outsiders_of_a_large_group(spark):
    """One large group with outsiders, most alike to none, some to one member only through words that few share: the cluster join loses no link and adds none."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(420):
        now = list(words)
        for _ in range(rng.choice([2, 3, 4, 5, 6, 8, 10])):
            now[rng.randrange(120)] = f"x{rng.randrange(40)}" if k % 3 else f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(now)))
    for k in range(0, 60, 2):  # pairs far from the group but near each other
        now = list(words)
        for p in rng.sample(range(120), 14):
            now[p] = f"y{k}_{p}"
        rows.append((len(rows), " ".join(now)))
        now[rng.randrange(120)] = "z"
        rows.append((len(rows), " ".join(now)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert 40 < len(want) < len(rows) - 40
    assert sorted(r.doc_id for r in jaccard.deduplicate(docs).collect()) == want


@pytest.mark.parametrize("most", [5, 1 << 19])
def test_partial_counts_add_up(monkeypatch, most):
    """Counts that are handed on early, and those of empty sets and batches, sum to the number of sets that hold a shingle."""
    monkeypatch.setattr(jaccard, "COUNTED", most)
    rng = random.Random(5)
    rows = [(rng.choice([-4, 0, 9]), rng.sample(range(-6, 30), rng.randrange(0, 12))) for _ in range(200)]
    column = lambda at: [pa.record_batch([pa.array([c for c, _ in part], pa.int64()), pa.array([f for _, f in part], pa.list_(pa.int64()))], names=["cluster", "found"]) for part in at]
    batches = column([rows[:70], [], rows[70:71], rows[71:]])
    got = Counter()
    for batch in jaccard._holders(iter(batches)):
        for c, s, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            got[c, s] += n
    assert got == Counter((c, s) for c, f in rows for s in f)
    assert sum(b.num_rows for b in jaccard._holders(iter(column([[(1, [])]])))) == 0
