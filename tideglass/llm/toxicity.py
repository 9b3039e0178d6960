"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: words, their first bytes (families of
words that share a beginning), neighbouring pairs, and pairs with one or two
words between.  Per-coordinate rates and the L1 penalty leave few weights;
they are kept by full 32-bit hash, so long texts do not fill up with chance
hits, and broadcast: no more than the features of the bounded sample.

The fit reads at most ``sample`` labelled documents, chosen by a hash of the
id, and drops features seen in fewer than ``rare`` of them.

Defined results: null and empty texts score as the bias alone; with no label
the score is 0, and everything is below the threshold; rows repeating an id
are scored each; labels repeating an id count once, as their greatest; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, bounded_batches, crc_mod, crc_unsigned, documents, forget, labels, released, sliced, tidy, within, written
from .quality import FEATURE_BYTES, labelled_sample

SAMPLE, RARE, EPOCHS, HEADS, STREAMS = 8000, 2, 6, (4, 6), 16
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.05

#: ASCII marks and white space part words; an apostrophe and a hyphen do too.
PARTED = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


class Families(dict):
    """Word -> row of the hashes of the word and of its heads; it starts anew beyond ``most`` words."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most
        self.rows = np.empty((1024, 1 + len(HEADS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[n] = [xxhash.xxh64_intdigest(word, 0), *(xxhash.xxh64_intdigest(word[:size], size) for size in HEADS)]
        self[word] = n
        return n

    def hashes(self, docs: Iterator[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words, end to end, and the words of each text."""
        if len(self) > self.most:
            self.clear()
        of = self.__getitem__
        parts = [np.fromiter(map(of, words), np.int64, len(words)) for words in docs]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return self.rows[at], np.array([len(x) for x in parts], np.int64)


_FAMILIES = Families()
KEPT.append(_FAMILIES.clear)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit features, owner) of all texts, repeats included, in no order."""
    rows, sizes = _FAMILIES.hashes(t.lower().encode("utf-8", "replace").translate(PARTED).split() for t in texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    one = rows[:, 0]
    parts, owners = [*rows.T], [owner] * rows.shape[1]
    for gap in (1, 2, 3):
        if len(one) > gap:
            inside = owner[:-gap] == owner[gap:]
            mixed = (one[:-gap] * np.uint64(0x9E3779B97F4A7C15) + one[gap:] * np.uint64(2 * gap + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            parts.append(mixed[inside])
            owners.append(owner[:-gap][inside])
    return (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal; w is read from z and n when needed."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        more = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - more * w
        self.n[at] += g * g


class Weights:
    """Features with a weight, sorted, and a bias."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bias: float):
        self.keys, self.values, self.bias = keys, values, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys & np.uint32((1 << 20) - 1)] = True

    def probability(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        keys, owner = hashed(texts)
        some = np.flatnonzero(self.maybe[keys & np.uint32((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), max(0, len(self.keys) - 1))
        hit = self.keys[at] == keys[some] if len(self.keys) else np.zeros(0, bool)
        pair = np.unique(owner[some][hit].astype(np.int64) << 32 | at[hit])
        z = self.bias + np.bincount(pair >> 32, self.values[pair & 0xFFFFFFFF], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@released
def fit(docs: DataFrame, table: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rare: int = RARE, epochs: int = EPOCHS, feature_bytes: int = FEATURE_BYTES) -> Weights:
    """docs and labels (id, label), joined on the id.  At most about ``sample`` rows, and ``feature_bytes`` of their features, are learnt from."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            keys, owner = hashed([x or "" for x in batch.column(0).to_pylist()])
            both = np.unique(owner.astype(np.uint64) << np.uint64(32) | keys)
            cuts = np.searchsorted(both, np.arange(batch.num_rows + 1).astype(np.uint64) << np.uint64(32))
            raw = both.astype(np.uint32)
            yield pa.record_batch([pa.array([raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), batch.column(1)], names=["keys", "label"])

    # a few partitions, read one at a time: the driver holds the sample's features once, and counts them in parts
    table = written(labelled_sample(docs, table, label, sample, id_col, text_col).mapInArrow(tidy(run), "keys binary, label double").repartition(STREAMS))
    raw: list[np.ndarray] = []
    label_of: list[float] = []
    for r in within(table, "keys", feature_bytes).toLocalIterator():
        raw.append(np.frombuffer(r.keys, np.uint32))
        label_of.append(r.label)
    keys = _frequent(raw, rare)
    rows: list[np.ndarray] = []
    for k, row in enumerate(raw):
        at = np.minimum(np.searchsorted(keys, row), max(0, len(keys) - 1))
        at = at[keys[at] == row] if len(keys) else at[:0]
        rows.append(np.append(at, len(keys)).astype(np.int32))  # the last is the bias
        raw[k] = row[:0].copy()
    forget(table)
    if not rows:
        return Weights(np.zeros(0, np.uint32), np.zeros(0), -30.0)
    model = Ftrl(len(keys) + 1)
    first = sorted(range(len(rows)), key=lambda k: (len(rows[k]), crc_unsigned(rows[k].tobytes())))  # whatever the order of rows
    rng = np.random.default_rng(13)
    for _ in range(epochs):
        for k in rng.permutation(first):
            model.learn(rows[k], label_of[k])
    w = model.weights()
    some = np.flatnonzero(w[:-1])
    return Weights(keys[some], w[some], float(w[-1]))


def _frequent(rows: list[np.ndarray], least: int, bits: int = 4) -> np.ndarray:
    """Features that ``least`` of the sorted rows or more hold, in order; counted by ranges, a sixteenth of them at a time."""
    out, step = [np.zeros(0, np.uint32)], 1 << (32 - bits)
    for low in range(0, 1 << 32, step):
        part = [row[np.searchsorted(row, np.uint32(low)) : np.searchsorted(row, np.uint32(low + step - 1), "right")] for row in rows]
        if part:
            k, c = np.unique(np.concatenate(part), return_counts=True)
            out.append(k[c >= least])
    return np.concatenate(out)


def score(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            yield pa.record_batch([batch.column(0), pa.array(sent.value.probability([x or "" for x in batch.column(1).to_pylist()]))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double")


def keep(docs: DataFrame, table: DataFrame, most: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``most``, with all their columns; fitted on the labels given."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, table, "toxic", id_col, text_col))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(sent.value.probability(texts) < most))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir).where(crc_mod("doc_id", 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
