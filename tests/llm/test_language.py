"""Language prediction end to end against plain loops over the definition."""

import numpy as np

from tideglass.llm import language as L


def slow_bundle(text, gram, dimensions):
    s = [int(c) for c in L.symbols(text)]
    out = np.zeros(dimensions)
    for k in range(len(s) - gram + 1):
        bound = np.ones(dimensions)
        for j in range(gram):
            bound = bound * np.roll(L.letter_vector(s[k + j], dimensions), gram - 1 - j)
        out += bound
    return out


def unit(v):
    size = np.sqrt((v * v).sum())
    return v / size if size else v


def test_fit_and_predict(spark, edge):
    rows = [(1, "the quick brown fox", "en"), (2, "a lazy dog and a fox", "en"), (3, "der schnelle Fuchs", "de"), (4, "ein fauler Hund", "de"), (5, "le renard brun", "fr"), (6, None, "fr"), (7, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    gram, dim = 3, 256
    model = L.fit(docs, gram=gram, dimensions=dim)
    langs = ["de", "en", "fr"]
    protos = [unit(sum(unit(slow_bundle(t or "", gram, dim)) for _, t, lang in rows if lang == x)) for x in langs]
    mean = sum(protos) / len(protos)
    protos = [unit(p - mean) for p in protos]
    assert model[0] == langs and np.allclose(model[1], protos, atol=1e-5) and np.allclose(model[2], mean, atol=1e-5)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(edge.where("doc_id <> 9"), model, gram=gram).collect()}
    for r in edge.where("doc_id <> 9").select("doc_id", "text").collect():
        b = slow_bundle(r.text or "", gram, dim)
        if not b.any():
            assert got[r.doc_id] == ("und", 0.0)
            continue
        cos = [float(unit(unit(b) - mean) @ p) for p in protos]
        assert got[r.doc_id][0] == langs[int(np.argmax(cos))] and abs(got[r.doc_id][1] - min(1, max(0, max(cos)))) < 1e-4
