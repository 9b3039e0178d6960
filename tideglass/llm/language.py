"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point, so
all tasks agree).  A letter n-gram is the product of its letters' vectors,
each rotated by its place; a document is the sum of its n-grams' vectors, and a
language the sum of its training documents' unit vectors, less the mean of all
languages, which holds what they share.  A text gets the language with the
greatest cosine.

A batch's distinct n-grams are bound once and bundled by one matrix product of
counts and vectors.  What is learnt is one vector for each language; the fit
reads at most ``per_language`` documents of each (chosen by a hash of the id).

Defined results: a null text, or one without a letter, is ``und`` with score
0; with nothing to learn from all are ``und``; ties go to the first language
in order; an empty table gives no rows; score is the cosine, at least 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, documents, sliced, tidy

DIMENSIONS, GRAM, PER_LANGUAGE = 1024, 3, 4000
#: Most cells of one matrix of counts, and of bound n-grams at a time.
CELLS, ROWS = 3_000_000, 8192

_STATE: dict = {}


def _letters() -> np.ndarray:
    """True at every code point that is a letter."""
    if "letters" not in _STATE:
        _STATE["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _STATE["letters"]


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    key = (code, dimensions)
    if key not in _STATE:
        if len(_STATE) > 20_000:
            _STATE.clear()
        _STATE[key] = (np.random.default_rng(code).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _STATE[key]


def symbols(text: str) -> np.ndarray:
    """Code points of lower-cased letters, runs of all else as one 0, and 0 at both ends; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[np.minimum(codes, 0x10FFFF)], codes, 0)
    if not codes.any():
        return np.zeros(0, np.uint32)
    codes = np.concatenate([[0], codes, [0]])
    return codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)].astype(np.uint32)


def bundles(texts: list[str], gram: int = GRAM, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each text: the sum of its n-grams' vectors."""
    out = np.zeros((len(texts), dimensions), np.float32)
    parts = [symbols(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    used = np.flatnonzero(sizes >= gram)
    if not len(used):
        return out
    codes = np.concatenate([parts[k] for k in used])
    doc = np.repeat(used, sizes[used])
    present = np.flatnonzero(np.bincount(codes))
    small = np.zeros(int(present[-1]) + 1, np.int64)
    small[present] = np.arange(len(present))
    codes = small[codes]
    n = len(codes) - gram + 1
    grams = np.zeros(n, np.int64)
    for k in range(gram):
        grams = grams * len(present) + codes[k : k + n]
    inside = doc[:n] == doc[gram - 1 :]
    grams, doc = grams[inside], doc[:n][inside]
    top = len(present) ** gram
    if top <= 1 << 22:
        seen = np.flatnonzero(np.bincount(grams, minlength=1))
        index = np.zeros(int(seen[-1]) + 1, np.int64)
        index[seen] = np.arange(len(seen))
        grams = index[grams]
    else:
        seen, grams = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(c), dimensions) for c in present])
    turned = [np.roll(letters, gram - 1 - k, axis=1) for k in range(gram)]
    step = max(1, CELLS // ROWS)
    for at in range(0, len(seen), ROWS):
        part, rest = seen[at : at + ROWS], seen[at : at + ROWS]
        bound = np.ones((len(part), dimensions), np.int8)
        for k in range(gram - 1, -1, -1):
            bound *= turned[k][rest % len(present)]
            rest = rest // len(present)
        bound = bound.astype(np.float32)
        mine = (grams >= at) & (grams < at + ROWS)
        own, which = doc[mine], grams[mine] - at
        for first in range(0, len(texts), step):
            rows = min(step, len(texts) - first)
            low, high = np.searchsorted(own, [first, first + rows])
            if high > low:
                counts = np.bincount((own[low:high] - first) * len(part) + which[low:high], minlength=rows * len(part)).reshape(rows, len(part))
                out[first : first + rows] += counts.astype(np.float32) @ bound
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, gram: int = GRAM, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their unit prototypes, and the mean taken off."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).where("lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, dimensions), np.float32), np.zeros(dimensions, np.float32)
    shares = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20)).select("lang", "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches, 1 << 20):
            langs, found = batch.column(0).to_pylist(), _unit(bundles(_strings(batch.column(1)), gram, dimensions))
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + found[[x == lang for x in langs]].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = sample.mapInArrow(tidy(add), "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    got = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).toPandas()
    langs = sorted(counts)
    table = np.zeros((len(langs), dimensions))
    table[[langs.index(x) for x in got["lang"]], got["k"].to_numpy()] = got["x"].to_numpy()
    table = _unit(table)
    mean = table.mean(axis=0) if len(langs) > 1 else np.zeros(dimensions)
    return langs, _unit(table - mean).astype(np.float32), mean.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """doc_id, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    langs, table, mean = model
    kind = docs.schema[id_col].dataType.simpleString()
    names = np.array([*langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            found = bundles(_strings(batch.column(1)), gram, table.shape[1])
            known = found.any(axis=1) & bool(langs)
            cosine = _unit(_unit(found) - mean) @ table.T if langs else np.zeros((len(found), 1))
            best = np.where(known, cosine.argmax(axis=1), len(langs))
            score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0)
            yield pa.record_batch([batch.column(0), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
