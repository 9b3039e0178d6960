"""Quality classifier: a factorisation machine.

Features of a text: its distinct words, hashed (value 1 / sqrt of their
number), and statistics of its structure and size, each put into one of
``bins`` ranges that the training sample's quantiles bound.  The score is the
logistic of w0 + sum w_i x_i + the low-rank pairwise interactions, taken in
linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The fit (Adagrad on the driver) reads at most ``sample`` labelled documents,
chosen by a hash of the id; the model is one row for each hashed word and bin,
fixed by parameters, so it may be broadcast at any input size.

Defined results: null and empty texts are scored by their statistics; without
a single label, or with one class only, the score is that class's share (0.5
with no label); rows repeating an id are scored each; labels repeating an id
count once, as their greatest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, documents, forget, hash_words, labels, released, sliced, text_bytes, tidy, within, written

WORDS, BINS, FACTORS, SAMPLE, EPOCHS = 1 << 15, 12, 8, 8000, 4
#: Bytes of the sample's features that the driver reads at most, however long the texts are.
FEATURE_BYTES = 192 << 20
NAMES = ("bytes", "words", "word_size", "distinct", "upper", "digit", "mark", "mark_run", "lone_mark", "line", "same_line", "same_next", "wide", "top_word")

#: Byte classes: 0 other, 1 lower-case letter, 2 upper-case, 3 digit, 4 white space, 5 mark, 6 part of a wider code point.
CLASS = np.array([6 if b >= 128 else 4 if chr(b).isspace() else 3 if chr(b).isdigit() else 2 if chr(b).isupper() else 1 if chr(b).islower() else 5 if chr(b).isprintable() else 0 for b in range(256)], np.uint8)


def structure(texts: list[bytes], hashes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Statistics of every text; keys, counts and owner are its distinct words."""
    n = len(texts)
    length = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n\n", np.uint8)
    kind = CLASS[data]
    doc = np.append(np.repeat(np.arange(n), length + 1), n)
    per = np.bincount(doc * 8 + kind, minlength=8 * (n + 1)).reshape(-1, 8)[:n].astype(float)
    per[:, 4] -= 1  # the parting line end
    mark, blank = kind == 5, kind == 4
    run = np.flatnonzero(mark[:-1] & (data[:-1] == data[1:]))
    lone = np.flatnonzero(mark[1:-1] & blank[:-2] & blank[2:]) + 1
    lines = np.flatnonzero(data == 10)
    same = np.zeros(n)
    for k, t in enumerate(texts):
        rows = [x for x in t.split(b"\n") if x]
        same[k] = 1 - len(set(rows)) / len(rows) if rows else 0
    first = np.concatenate([[0], np.cumsum(sizes)])
    owners = np.repeat(np.arange(n), sizes)
    again = np.flatnonzero((hashes[:-1] == hashes[1:]) & (owners[:-1] == owners[1:]))
    top = np.zeros(n)
    np.maximum.at(top, owner, counts)
    letters = np.maximum(per[:, 1] + per[:, 2] + per[:, 6], 1)
    size, words = np.maximum(length, 1), np.maximum(np.diff(first), 1)
    of = lambda at: np.bincount(doc[at], minlength=n + 1)[:n]
    return np.stack(
        [
            np.log1p(length), np.log1p(sizes), length / words, np.bincount(owner, minlength=n) / words, per[:, 2] / letters, per[:, 3] / size, per[:, 5] / size,
            of(run) / size, of(lone) / words, (of(lines) - 1) / size, same, np.bincount(owners[again], minlength=n) / words, per[:, 6] / size, top / words,
        ],
        axis=1,
    )


def features(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashed words of all texts end to end, how many each text has, statistics)."""
    hashes, sizes = hash_words(t.lower().split() for t in texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys, counts = np.unique(owner.astype(np.uint64) * np.uint64(words) + hashes % np.uint64(words), return_counts=True)
    owner, keys = (keys // np.uint64(words)).astype(np.int64), (keys % np.uint64(words)).astype(np.int64)
    return keys, np.bincount(owner, minlength=len(texts)), structure(texts, hashes, sizes, keys, counts, owner)


class Machine:
    """w0, w, v over hashed words and then over the bins of every statistic."""

    def __init__(self, edges: np.ndarray, words: int, bins: int, factors: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = words + bins * len(NAMES)
        self.edges, self.words, self.bins = edges, words, bins
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.05, (size, factors)).astype(np.float32)

    def rows(self, keys: np.ndarray, sizes: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, owner) of every feature: words, then statistics."""
        n = len(sizes)
        value = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        binned = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats.T, strict=True)], axis=1)
        more = self.words + np.arange(len(NAMES)) * self.bins + binned
        owner = np.concatenate([np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), len(NAMES))])
        return np.concatenate([keys, more.ravel()]), np.concatenate([value, np.ones(more.size)]).astype(np.float32), owner

    def margin(self, index: np.ndarray, value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits by the sum-of-squares identity, and the sums that their gradient needs."""
        vx = self.v[index] * value[:, None]
        sums = np.stack([np.bincount(owner, vx[:, f], n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(owner, np.einsum("ij,ij->i", vx, vx), n)
        return self.w0 + np.bincount(owner, self.w[index] * value, n) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def probability(self, keys: np.ndarray, sizes: np.ndarray, stats: np.ndarray) -> np.ndarray:
        index, value, owner = self.rows(keys, sizes, stats)
        return 1 / (1 + np.exp(-np.clip(self.margin(index, value, owner, len(sizes))[0], -30, 30)))


def fit_machine(keys: list[np.ndarray], stats: np.ndarray, label: np.ndarray, words: int = WORDS, bins: int = BINS, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, together: int = 64) -> Machine:
    edges = np.quantile(stats, np.arange(1, bins) / bins, axis=0).T
    model = Machine(edges, words, bins, factors)
    share = min(1 - 1e-3, max(1e-3, label.mean()))
    model.w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(len(model.w), 1e-6, np.float32), np.full(model.v.shape, 1e-6, np.float32), 1e-6
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), together):
            part = order[at : at + together]
            sizes = np.array([len(keys[k]) for k in part])
            index, value, owner = model.rows(np.concatenate([keys[k] for k in part]), sizes, stats[part])
            z, sums = model.margin(index, value, owner, len(part))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)).astype(np.float32)
            e = error[owner] * value
            touched, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, e, len(touched)) + decay * model.w[touched]
            grad = e[:, None] * (sums[owner] - model.v[index] * value[:, None])
            dv = np.stack([np.bincount(where, grad[:, f], len(touched)) for f in range(factors)], axis=1) + decay * model.v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            model.w[touched] -= rate * dw / np.sqrt(gw[touched])
            model.v[touched] -= rate * 0.3 * dv / np.sqrt(gv[touched])
            d0 = float(error.sum())
            g0 += d0 * d0
            model.w0 -= rate * d0 / g0**0.5
    return model


class Constant:
    def __init__(self, share: float):
        self.share = share

    def probability(self, keys, sizes, stats) -> np.ndarray:
        return np.full(len(sizes), self.share)


def labelled_sample(docs: DataFrame, table: DataFrame, label: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """text, label of at most about ``sample`` labelled rows, chosen by a hash of the id.

    The ids are chosen first, among the labels: a parameter's number of them is
    collected and pushed to the scan as a list, so that a large table is read
    only where a row group can hold one.
    """
    ids = table.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("double").alias("label"))
    n = written(ids.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi"))
    total = n.count()
    share = min(1.0, sample / total) if total else 0.0
    chosen = n.where(F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1 << 24)) < int(share * (1 << 24)) + (share >= 1.0)).collect()
    forget(n)
    few = docs.sparkSession.createDataFrame(chosen, n.schema)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return rows.where(F.col("__id").isin([r["__id"] for r in chosen])).join(F.broadcast(few), "__id").select("text", "label")


@released
def fit(docs: DataFrame, table: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, words: int = WORDS, feature_bytes: int = FEATURE_BYTES) -> Machine | Constant:
    """docs and labels (id, label), joined on the id.  At most about ``sample`` rows, and ``feature_bytes`` of their features, are learnt from."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            keys, sizes, stats = features(text_bytes(batch.column(0)), words)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            raw = keys.astype(np.uint16 if words <= 1 << 16 else np.uint32)
            yield pa.record_batch([pa.array([raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array(stats.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["keys", "stats", "label"])

    made = written(labelled_sample(docs, table, label, sample, id_col, text_col).mapInArrow(tidy(run), "keys binary, stats array<double>, label double"))
    got = within(made, "keys", feature_bytes).toArrow()
    forget(made)
    label_of = got.column("label").to_numpy()
    if len(set(label_of)) < 2:
        return Constant(float(label_of.mean()) if len(label_of) else 0.5)
    kind = np.uint16 if words <= 1 << 16 else np.uint32
    raw = got.column("keys").to_pylist()
    keys = [np.frombuffer(x, kind).astype(np.int64) for x in raw]
    stats = np.array(got.column("stats").to_pylist())
    order = sorted(range(len(raw)), key=lambda k: (raw[k][:64], stats[k].tolist()))  # whatever the order of rows
    return fit_machine([keys[k] for k in order], stats[order], label_of[order], words)


def score(docs: DataFrame, model: Machine | Constant, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, score of every row."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            found = sent.value.probability(*features(text_bytes(batch.column(1)), words))
            yield pa.record_batch([batch.column(0), pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double")


def keep(docs: DataFrame, table: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns; fitted on the labels given."""
    model = fit(docs, table, "quality", id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2 << 20):
            found = sent.value.probability(*features(text_bytes(batch.column(batch.schema.get_field_index(text_col)))))
            yield batch.filter(pa.array(found >= least))

    return docs.mapInArrow(tidy(run), docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir).where(crc_mod("doc_id", 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
