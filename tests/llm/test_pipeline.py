import re

import corpus_pipeline as C
from pyspark.sql import functions as F
from tideglass.llm import packing, quality, simhash, toxicity
from tideglass.llm.common import crc_mod, labels


def test_stages(spark, sf_dir, docs):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "toxicity", "exact_dedup", "simhash_near_dedup", "packing"]
    fit_on = labels(spark, sf_dir).where(crc_mod("doc_id", 5) != 0)
    now = docs
    for name, stage in C.STAGES:
        after = stage(spark, now, sf_dir).cache()
        if name != "packing":
            assert after.schema.names == docs.schema.names
            kept, before = {r.doc_id for r in after.collect()}, {r.doc_id: r.text for r in now.collect()}
            assert kept <= set(before)
        if name == "quality":
            assert kept == {r.doc_id for r in quality.score(now, quality.fit(now, fit_on)).where("score >= 0.3").collect()}
        if name == "toxicity":
            assert kept == {r.doc_id for r in toxicity.score(now, toxicity.fit(now, fit_on)).where("score < 0.5").collect()}
        if name == "exact_dedup":
            bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t) for i, t in before.items()}
            assert sorted(bare[i] for i in kept) == sorted(set(bare.values()))
        if name == "simhash_near_dedup":
            prints = [simhash.fingerprint(before[i].encode()) for i in sorted(kept)]
            assert all(bin(a ^ b).count("1") > 3 for k, a in enumerate(prints) for b in prints[:k])
        if name == "packing":
            rows = after.collect()
            assert {r.doc_id for r in rows} == set(before)
            assert max(sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}) <= packing.CAPACITY
        now = after


def test_run(spark, sf_dir, docs):
    got = C.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < got.select("doc_id").distinct().count() < docs.count()


def test_classifiers_on_edges(spark, edge, empty):
    table = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 1, 1), (9, 0, 1), (12, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(edge, table)
        rows = module.score(edge, model).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.score(empty, model).collect() == []
        assert module.keep(edge, table).columns == edge.columns
        none = module.fit(edge, table.where("false"))
        assert len(module.score(edge, none).collect()) == edge.count()
        assert module.keep(edge, table.where("false")).count() == edge.count()


def test_factorisation_identity(texts):
    """The linear-time form equals the sum over all pairs."""
    import numpy as np

    m = quality.Machine(np.sort(np.random.default_rng(0).random((len(quality.NAMES), quality.BINS - 1)), axis=1), 50, quality.BINS, 4)
    m.w = np.random.default_rng(1).normal(size=len(m.w)).astype(np.float32)
    index, value = np.array([3, 7, 9, 3 + 40]), np.array([1.0, 0.5, 2.0, 0.1], np.float32)
    z, _ = m.margin(index, value, np.zeros(4, int), 1)
    slow = m.w0 + m.w[index] @ value + sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert abs(z[0] - slow) < 1e-5


def accuracy(rows, table, column):
    truth = {r.doc_id: r[column] for r in table.collect()}
    rows = [r for r in rows if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    table = labels(spark, sf)
    assert accuracy(quality.op2_quality(spark, sf).collect(), table, "quality") > 0.95
    assert accuracy(toxicity.op3_toxicity(spark, sf).collect(), table, "toxic") > 0.85


def test_language(spark, edge, empty):
    from tideglass.llm import language

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in language.op1_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.98
    model = language.fit(edge.where(F.col("lang") != "la"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(edge, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in model[0]
    assert language.predict(empty, model).collect() == []
    assert {r.lang_pred for r in language.predict(edge, language.fit(empty)).collect()} == {"und"}


def test_bundles_are_sums_of_bound_letters(texts):
    import numpy as np

    from tideglass.llm import language

    text = "Abc, é"
    want = np.zeros(64)
    s = language.symbols(text)
    assert s.tolist() == [0, 97, 98, 99, 0, 233, 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        want += np.roll(language.letter_vector(int(a), 64), 2) * np.roll(language.letter_vector(int(b), 64), 1) * language.letter_vector(int(c), 64)
    assert np.array_equal(language.bundles(["", text, "1"], dimensions=64), np.stack([0 * want, want, 0 * want]))
