"""Katz backoff scoring: Good-Turing discounted counts, exactly normalised backoff weights.

The model has every training word; n-grams of ``order`` words (2 by default)
look back to that.  A text is its words and one end, which also stands before
its first word.  c: counts, d: Good-Turing discounts of each order,

  p(w) = d c(w) / N, and one unseen word has what that leaves;
  p(w|h) = d c(hw) / D(h) if hw was seen, else alpha(h) p(w|h less its first word),

D(h) being the counts after h (and half a token more where the discounts leave
nothing), and alpha(h) such that the words after h, and the unseen one, sum to
one.  Unseen histories have alpha 1.

Counts cover all training documents and are kept in tables partitioned into
buckets.  An n-gram lies where what it backs off to lies, or else where its
history lies, so that its value can be found in its bucket.  Words and n-grams
that are frequent (``hot_words``, ``hot`` of each order: bounds of a cache,
which change no result) are known to every task instead; an n-gram of which
both the suffix and the history are frequent lies by its own hash.  So no
bucket collects what follows a common word, and none is asked for it: the
buckets' shares of n-grams are those of rare words.

Per token the recursion is log p(w) + sum over orders of (log alpha(h), and if
hw was seen its gain: log p(w|h) - log alpha(h) - log p(w|shorter h)).  Every
term belongs to one word or n-gram, so a batch of documents asks for its
distinct ones, sorted and compressed, and is answered with sums by document.

Words and n-grams are known by 63- and 64-bit hashes.  Defined results: a null
or empty text is one end token; repeated rows are scored each; a null doc_id
is a training document; with no training document every token is unseen
(N = 0); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, buckets, crc_mod, documents, hash_words, input_bytes, text_bytes, tidy, written

#: Words of history and the word itself; sizes of the caches; counts up to FEW are discounted.
ORDER, HOT_WORDS, HOT, FEW = 2, 150_000, 150_000, 5
#: Bytes of text in one batch, of input for a bucket, and n-grams in one row of a table.
TEXT_BYTES, BUCKET_BYTES, CELL = 3 << 20, 48 << 20, 1 << 20
#: The id of the end; codes of words that are not in the cache have the top bit.
END, COLD = 0, np.uint64(1 << 63)
#: Kinds of rows: tables of order j are of kind j, weights of its histories WEIGHTS + j, questions ASKED + j.
HISTOGRAM, HOT_SUMS, SUMS, WEIGHTS, ASKED = 50, 60, 70, 100, 200


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal rank lie together."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes()
        parts.append(f"{raw.dtype.str},{len(raw)};".encode().ljust(24) + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _spread(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        kind, n = raw[at : at + 24].split(b";")[0].decode().split(",")
        width, n = np.dtype(kind).itemsize, int(n)
        at += 24
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def _undo(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas, dtype=deltas.dtype)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each row of word codes."""
    key = np.full(len(columns[0]), 0x9E3779B97F4A7C15 * len(columns) % 2**64, np.uint64)
    for c in columns:
        key = (key ^ c) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    return key


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _in_order(columns: list[np.ndarray], where: np.ndarray | None = None) -> np.ndarray:
    """The order of rows by bucket, in it of codes; equal rows lie together.  Rows of two short codes are sorted as one number, before all others."""
    short = np.uint64(1 << 21)
    if len(columns) != 2 or where is not None and len(where) and where.max() >= 1 << 21:
        return np.lexsort((*columns[::-1], where)) if where is not None else np.lexsort(columns[::-1])
    a, b = columns
    some = (a < short) & (b < short)
    hot, rest = np.flatnonzero(some), np.flatnonzero(~some)
    number = a[hot] << np.uint64(21) | b[hot]
    if where is not None:
        number |= where[hot].astype(np.uint64) << np.uint64(42)
    hot, rest = hot[np.argsort(number)], rest[np.lexsort((b[rest], a[rest]) if where is None else (b[rest], a[rest], where[rest]))]
    order = np.concatenate([hot, rest])
    return order if where is None else order[np.argsort(where[order], kind="stable")]


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """First rows of runs of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _dealt(where: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Each bucket with its part of rows sorted by bucket."""
    cuts = np.searchsorted(where, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(int(cuts[b]), int(cuts[b + 1]))


def _texts(batches: Iterator[pa.RecordBatch], most: int = TEXT_BYTES) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch number, doc_id, held out, word hashes with an end after each text, tokens of each text)."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24

    def made(held: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        hashes, sizes = hash_words(x.lower().split() + [b""] for part in table.column("text").chunks for x in text_bytes(part))
        hashes |= COLD
        ids = table.column("doc_id").combine_chunks()
        return number, ids, np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool), hashes, sizes

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield made(held)
            held, size, number = [], 0, number + 1
    if held:
        yield made(held)


EXCHANGED = "bucket int, kind int, batch long, data binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    b, k, n, d = zip(*rows, strict=True)
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(d, pa.binary())], names=["bucket", "kind", "batch", "data"])


def _gathered(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[tuple[int, Iterator[tuple[int, bytes]]]]]]:
    """Sorted rows -> each key with its kinds, and each kind with its (batch, data); rows are read as they come."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in (by, "kind", "batch", "data")), strict=True)

    for key, part in groupby(rows(), key=lambda r: r[0]):
        yield key, ((kind, ((r[2], r[3]) for r in some)) for kind, some in groupby(part, key=lambda r: r[1]))


def _by_bucket(df: DataFrame, n: int, by: str = "bucket") -> DataFrame:
    return df.repartition(n, by).sortWithinPartitions(by, "kind")


def _packed(columns: list[np.ndarray], *values: np.ndarray) -> bytes:
    """Rows of codes, sorted, with what goes along: the first column as differences."""
    return _squeeze(_deltas(columns[0]), *columns[1:], *values)


def _unpacked(block: bytes) -> list[np.ndarray]:
    first, *rest = _spread(block)
    return [_undo(first), *rest]


def _added(pieces: Iterator[list[np.ndarray]], n_codes: int, most: int = 2_000_000) -> list[np.ndarray]:
    """Counts of equal rows of codes added up, sorted; no more than the distinct rows and ``most`` others are held."""

    def folded(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = _in_order(columns[:n_codes])
        columns = [c[order] for c in columns]
        first = _runs(columns[:n_codes])
        return [*(c[first] for c in columns[:n_codes]), np.add.reduceat(columns[n_codes].astype(np.int64), first)]

    held: list[list[np.ndarray]] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size > most + 2 * len(held[0][0]):
            held = [folded(held)]
            size = len(held[0][0])
    return folded(held) if held else [*[np.zeros(0, np.uint64)] * n_codes, np.zeros(0, np.int64)]


def _histogram(made: DataFrame) -> dict[int, int]:
    """How many n-grams have each count: as many rows as there are different counts."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                c, n = _spread(data)
                yield pa.record_batch([pa.array(c), pa.array(n)], names=["c", "n"])

    return {r.c: r.n for r in made.where(F.col("kind") == HISTOGRAM).mapInArrow(tidy(run), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}


def _at_least(histogram: dict[int, int], most: int) -> int:
    """The least count that at most ``most`` keys reach."""
    total, least = 0, max(histogram, default=0) + 1
    for c in sorted(histogram, reverse=True):
        total += histogram[c]
        if total > most:
            break
        least = c
    return least


def _frequent(made: DataFrame, order: int, least: int, end: np.uint64 | int = END) -> list[np.ndarray]:
    """Codes and counts of the n-grams with ``least`` or more, whose number was bounded by _at_least(), and of that of ends only."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                columns = _unpacked(data)
                some = (columns[-1] >= least) | np.logical_and.reduce([c == end for c in columns[:-1]])
                yield pa.record_batch([pa.array(c[some].astype(np.uint64).view(np.int64)) for c in columns], names=[f"x{k}" for k in range(order + 1)])

    got = made.where(F.col("kind") == order).mapInArrow(tidy(run), ", ".join(f"x{k} long" for k in range(order + 1))).toArrow()
    columns = [got.column(k).to_numpy() for k in range(order + 1)]
    return [*(c.view(np.uint64) for c in columns[:-1]), columns[-1]]


def discounts(n: dict[int, int], few: int = FEW) -> np.ndarray:
    """d[c] for c = 0..few; above, 1.  Katz's form of Good-Turing; absolute discounts where the counts of counts forbid it."""
    at = lambda r: n.get(r, 0)
    out = np.ones(few + 1)
    if at(1):
        a = (few + 1) * at(few + 1) / at(1)
        with np.errstate(all="ignore"):
            d = np.array([((r + 1) * at(r + 1) / (r * at(r)) - a) / (1 - a) if at(r) and a != 1 else -1 for r in range(1, few + 1)])
        less = min(0.9, max(0.1, at(1) / (at(1) + 2 * at(2))))
        plain = np.array([(r - less) / r for r in range(1, few + 1)])
        out[1:] = np.where((d > 0) & (d < 1), d, plain)
    return out


@dataclass
class Cache:
    """Frequent n-grams of one order: what is known of them everywhere, sorted by key."""

    key: np.ndarray
    codes: list[np.ndarray]
    count: np.ndarray
    log_p: np.ndarray
    gain: np.ndarray
    #: As a history of the next order: D and log alpha.
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def value(self) -> np.ndarray:
        """What an occurrence adds: its gain, and its log alpha for the next token.  Only ends (the history before a text) never go on."""
        more = self.log_alpha if len(self.log_alpha) else np.zeros(len(self.key))
        return self.gain + np.where(np.logical_and.reduce([c == END for c in self.codes]) if len(self.codes) > 1 else False, 0.0, more)


class Model:
    """The bounded part of the model, which every task is sent: caches, discounts and totals."""

    def __init__(self, order: int, few: int, n: int, total: int, distinct: int, words: tuple[np.ndarray, np.ndarray], histogram: dict[int, int], end_hash: np.uint64):
        self.order, self.few, self.n = order, few, n
        self.total, self.distinct = total, distinct
        hashes, counts = words
        ids = np.argsort(np.where(hashes == end_hash, np.iinfo(np.int64).min, -counts), kind="stable")  # the end first, then by count
        hashes, counts = hashes[ids], counts[ids]
        if not len(hashes) or hashes[0] != end_hash:
            hashes, counts = np.concatenate([[end_hash], hashes]).astype(np.uint64), np.concatenate([[0], counts])
        by = np.argsort(hashes)
        self.word, self.word_id = hashes[by], by.astype(np.uint64)
        self.d = {1: discounts(histogram, few)}
        kept = sum(m * self.discounted(1, np.array([c]))[0] for c, m in histogram.items())
        self.mass = max(total + (0.5 if total - kept < 1e-9 else 0.0), 0.5)
        self.log_unseen = float(np.log10((self.mass - kept) / self.mass))
        codes = np.arange(len(counts), dtype=np.uint64)
        self.cache = {1: Cache(codes, [codes], counts, self.log_word(counts), np.zeros(len(codes)))}

    def discounted(self, order: int, counts: np.ndarray) -> np.ndarray:
        d = self.d[order]
        return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)

    def log_word(self, counts: np.ndarray) -> np.ndarray:
        """log10 p of words with these counts; 0 is the unseen word."""
        with np.errstate(divide="ignore"):
            return np.where(counts > 0, np.log10(self.discounted(1, counts) / self.mass), self.log_unseen)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """ids of cached words, hashes of all others."""
        at, there = _find(self.word, hashes)
        return np.where(there, self.word_id[at], hashes)

    def grams(self, codes: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
        """The n-gram that ends at each token, as columns of codes; ends stand before a text."""
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = []
        for back in range(order - 1, -1, -1):
            moved = np.concatenate([np.zeros(min(back, len(codes)), np.uint64), codes[: max(0, len(codes) - back)]])
            out.append(np.where(place < back, np.uint64(END), moved))
        return out

    def cached(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams are in the cache of their order, and whether they are."""
        if len(columns) == 1:
            there = columns[0] < COLD
            return np.where(there, columns[0], 0).astype(np.int64), there
        if len(columns) not in self.cache:
            return np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), bool)
        return _find(self.cache[len(columns)].key, _mixed(columns))

    def route(self, columns: list[np.ndarray]) -> np.ndarray:
        """The key by which an n-gram's bucket is chosen: that of its suffix, or else of its history, unless these are cached."""
        key = _mixed(columns)
        if len(columns) > 1:
            for part in (columns[:-1], columns[1:]):
                key = np.where(self.cached(part)[1], key, self.route(part))
        return key

    def remember(self, order: int, columns: list[np.ndarray]) -> None:
        """Cache frequent n-grams (codes, counts) of which the suffix and the history are cached, and the ends before a text."""
        *codes, counts = columns
        ends = np.logical_and.reduce([c == END for c in codes])
        codes = [np.concatenate([c[~ends], [END]]).astype(np.uint64) for c in codes]
        counts = np.concatenate([counts[~ends], [counts[ends].sum()]])
        some = self.cached(codes[:-1])[1] & self.cached(codes[1:])[1]
        codes, counts = [c[some] for c in codes], counts[some]
        key = _mixed(codes)
        by = np.argsort(key)
        codes, counts, key = [c[by] for c in codes], counts[by], key[by]
        before, lower = self.cache[order - 1], self.cache[order - 1]
        h, low = self.cached(codes[:-1])[0], self.cached(codes[1:])[0]
        with np.errstate(divide="ignore"):
            log_p = np.where(counts > 0, np.log10(self.discounted(order, counts) / before.total[h]), 0.0)
        self.cache[order] = Cache(key, codes, counts, log_p, np.where(counts > 0, log_p - before.log_alpha[h] - lower.log_p[low], 0.0))

    def weights(self, order: int, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """D and log alpha of histories with these sums: count, n-grams seen 1, 2, .. few times, lower probabilities."""
        c, *times, p = sums
        kept = c - sum(r * n * (1 - self.d[order][r]) for r, n in zip(range(1, self.few + 1), times, strict=True))
        total = np.where(c > 0, c + np.where(c - kept < 1e-9, 0.5, 0.0), 1.0)
        alpha = (1 - kept / total) / np.maximum(1 - p, 1e-15)
        return total, np.where(c > 0, np.log10(np.where(c > 0, alpha, 1.0)), 0.0)


class Tables:
    """What one bucket holds, as far as its rows have come: counts of words and n-grams, weights of histories."""

    def __init__(self, model: Model):
        self.m = model
        self.counts: dict[int, list[np.ndarray]] = {}
        self.known: dict[int, list[np.ndarray]] = {}
        self.values: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def take(self, kind: int, blocks: Iterator[tuple[int, bytes]]) -> None:
        columns = [np.concatenate(x) for x in zip(*(_unpacked(data) for _, data in blocks), strict=True)]
        if 1 < kind < WEIGHTS:
            self.counts[kind] = columns
            return
        by = np.argsort(columns[0], kind="stable")
        columns = [c[by] for c in columns]
        if kind == 1:
            self.counts[1] = columns
        else:
            self.known[kind - WEIGHTS] = columns

    def history(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """D and log alpha of histories; 1 and 0 where unseen."""
        order = len(columns) + 1
        at, there = self.m.cached(columns)
        total, log_alpha = np.ones(len(at)), np.zeros(len(at))
        cache = self.m.cache[order - 1] if order - 1 in self.m.cache else None
        if cache is not None and len(cache.total):
            total[there], log_alpha[there] = cache.total[at[there]], cache.log_alpha[at[there]]
        if order in self.known and not there.all():
            keys, d, a = self.known[order]
            rest = np.flatnonzero(~there)
            at, there = _find(keys, _mixed([c[rest] for c in columns]))
            total[rest[there]], log_alpha[rest[there]] = d[at[there]], a[at[there]]
        return total, log_alpha

    def log_p(self, columns: list[np.ndarray]) -> np.ndarray:
        """log10 p of words, or of n-grams after their histories, which are cached or lie in this bucket; unseen words included."""
        order = len(columns)
        at, there = self.m.cached(columns)
        out = np.where(there, self.m.cache[order].log_p[at], 0.0)
        rest = np.flatnonzero(~there)
        if len(rest):
            columns = [c[rest] for c in columns]
            out[rest] = self.m.log_word(self.word_counts(columns[0])) if order == 1 else self._valued(order, columns)[0]
        return out

    def word_counts(self, codes: np.ndarray) -> np.ndarray:
        keys, counts = self.counts.get(1, [np.zeros(0, np.uint64), np.zeros(0, np.int64)])
        at, there = _find(keys, codes)
        return np.where(there, counts[at] if len(counts) else 0, 0)

    def _valued(self, order: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 p and gain of n-grams of this bucket's table; 0 where they are not in it."""
        if order not in self.counts:
            return np.zeros(len(columns[0])), np.zeros(len(columns[0]))
        if order not in self.values:
            *codes, counts = self.counts[order]
            total, log_alpha = self.history(codes[:-1])
            log_p = np.log10(self.m.discounted(order, counts) / total)
            gain, key = log_p - log_alpha - self.log_p(codes[1:]), _mixed(codes)
            by = np.argsort(key)
            self.values[order] = (key[by], log_p[by], gain[by])
        keys, log_p, gain = self.values[order]
        at, there = _find(keys, _mixed(columns))
        return np.where(there, log_p[at], 0.0), np.where(there, gain[at], 0.0)

    def value(self, columns: list[np.ndarray]) -> np.ndarray:
        """What an occurrence of an n-gram that is not cached adds to a score: its gain, and its log alpha for the next token."""
        return self._valued(len(columns), columns)[1] + (self.history(columns)[1] if len(columns) < self.m.order else 0.0)


def _cells(bucket: int, kind: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), CELL):
        yield _rows([(bucket, kind, 0, _packed([c[at : at + CELL] for c in columns]))])


def _counted(bucket: int, order: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A bucket's table, and how often each count is in it."""
    yield from _cells(bucket, order, columns)
    c, n = np.unique(columns[-1], return_counts=True)
    yield _rows([(bucket, HISTOGRAM, 0, _squeeze(c.astype(np.int64), n.astype(np.int64)))])


def _word_counts(docs: DataFrame, n: int) -> DataFrame:
    """A written table of the counts of training words, by hash, and their histogram."""

    def emit(batches):
        for _, _, held_out, hashes, sizes in _texts(batches):
            keys, counts = np.unique(hashes[np.repeat(~held_out, sizes)], return_counts=True)
            where = _bucket(_mixed([keys]), n)
            by = np.argsort(where, kind="stable")
            keys, counts = keys[by], counts[by].astype(np.uint32)
            rows = [(b, 1, 0, _packed([keys[part]], counts[part])) for b, part in _dealt(where[by], n)]
            if rows:
                yield _rows(rows)

    def add(batches):
        for bucket, kinds in _gathered(batches, "bucket"):
            for _, blocks in kinds:
                yield from _counted(bucket, 1, _added((_unpacked(data) for _, data in blocks), 1))

    return written(_by_bucket(docs.mapInArrow(tidy(emit), EXCHANGED), n).mapInArrow(tidy(add), EXCHANGED))


def _gram_counts(docs: DataFrame, sent, order: int, lower: DataFrame) -> DataFrame:
    """A written table of the counts of training n-grams, their histogram, and sums by history: for D and alpha.

    ``lower``: tables and weights of the lower orders, with which a bucket's n-grams meet.
    """
    n = sent.value.n

    def emit(batches):
        m = sent.value
        for _, _, held_out, hashes, sizes in _texts(batches):
            train = np.repeat(~held_out, sizes)
            columns = m.grams(m.codes(hashes[train]), sizes[~held_out], order)
            where = _bucket(m.route(columns), n)
            by = _in_order(columns, where)
            where, columns = where[by], [c[by] for c in columns]
            first = _runs([where, *columns])
            counts = np.diff(np.append(first, len(where))).astype(np.uint32)
            columns = [c[first] for c in columns]
            rows = [(b, order, 0, _packed([c[part] for c in columns], counts[part])) for b, part in _dealt(where[first], n)]
            if rows:
                yield _rows(rows)

    def sums_of(tables: Tables, columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        """Histories, one row each, with their sums."""
        m = tables.m
        *codes, counts = columns
        before = codes[:-1]
        p = 10.0 ** tables.log_p(codes[1:])
        by = np.argsort(_mixed(before), kind="stable")
        before = [c[by] for c in before]
        first = _runs(before)
        added = [np.add.reduceat(x[by], first) for x in (counts, *((counts == r).astype(np.int64) for r in range(1, m.few + 1)), p)] if len(first) else []
        return [c[first] for c in before], added

    def add(batches):
        m = sent.value
        for bucket, kinds in _gathered(batches, "bucket"):
            tables = Tables(m)
            for kind, blocks in kinds:
                if kind != ASKED:
                    tables.take(kind, blocks)
                    continue
                columns = _added((_unpacked(data) for _, data in blocks), order)
                yield from _counted(bucket, order, columns)
                before, added = sums_of(tables, columns)
                at, there = m.cached(before)
                rows = []
                if there.any():
                    rows.append((bucket, HOT_SUMS, 0, _squeeze(at[there], *(x[there] for x in added))))
                before, added = [c[~there] for c in before], [x[~there] for x in added]
                key, where = _mixed(before), _bucket(m.route(before), n)
                by = np.lexsort((key, where))
                rows += [(b, SUMS, bucket, _packed([key[by][part]], *(x[by][part] for x in added))) for b, part in _dealt(where[by], n)]
                if rows:
                    yield _rows(rows)

    new = docs.mapInArrow(tidy(emit), EXCHANGED).withColumn("kind", F.lit(ASKED))  # after the tables
    return written(_by_bucket(lower.unionByName(new), n).mapInArrow(tidy(add), EXCHANGED))


def _hot_sums(made: DataFrame, few: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of cached histories: as many rows as the cache has."""
    names = ["at", "c", *[f"n{r}" for r in range(1, few + 1)], "p"]

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.record_batch([pa.array(x) for x in _spread(data)], names=names)

    kinds = ", ".join(f"{x} {'double' if x == 'p' else 'long'}" for x in names)
    got = made.where(F.col("kind") == HOT_SUMS).mapInArrow(tidy(run), kinds).groupBy("at").agg(*(F.sum(x).alias(x) for x in names[1:])).toArrow()
    return got.column("at").to_numpy(), [got.column(x).to_numpy() for x in names[1:]]


def _weights(made: DataFrame, sent, order: int) -> DataFrame:
    """A written table of D and log alpha of the other histories, in their buckets and in those that hold n-grams of them."""
    n = sent.value.n

    def run(batches):
        m = sent.value
        for bucket, kinds in _gathered(batches, "bucket"):
            for _, blocks in kinds:
                parts = [(origin, _unpacked(data)) for origin, data in blocks]
                keys, *sums = (np.concatenate(x) for x in zip(*(columns for _, columns in parts), strict=True))
                by = np.argsort(keys, kind="stable")
                first = _runs([keys[by]])
                total, log_alpha = m.weights(order, [np.add.reduceat(x[by], first) for x in sums])
                keys = keys[by][first]
                yield _rows([(bucket, WEIGHTS + order, 0, _packed([keys], total, log_alpha))])
                for origin, (mine, *_) in parts:
                    if origin != bucket:
                        at = np.searchsorted(keys, mine)
                        yield _rows([(origin, WEIGHTS + order, 0, _packed([mine], total[at], log_alpha[at]))])

    return written(_by_bucket(made.where(F.col("kind") == SUMS), n).mapInArrow(tidy(run), EXCHANGED))


def train(docs: DataFrame, n: int, order: int = ORDER, hot_words: int = HOT_WORDS, hot: int = HOT, few: int = FEW) -> tuple[Model, DataFrame]:
    """docs (doc_id, text, held_out) -> the bounded part, and the tables of words, n-grams and weights by bucket."""
    sc = docs.sparkSession.sparkContext
    made = _word_counts(docs, n)
    histogram = _histogram(made)
    total, distinct = sum(c * m for c, m in histogram.items()), sum(histogram.values())
    end = hash_words([[b""]])[0][0] | COLD
    words = _frequent(made, 1, _at_least(histogram, hot_words), end)
    model = Model(order, few, n, total, distinct, tuple(words), histogram, end)
    tables = made.where(F.col("kind") == 1)
    for j in range(2, order + 1):
        made = _gram_counts(docs, sc.broadcast(model), j, tables)
        histogram = _histogram(made)
        model.d[j] = discounts(histogram, few)
        at, sums = _hot_sums(made, few)
        cache = model.cache[j - 1]
        cache.total, cache.log_alpha = np.ones(len(cache.key)), np.zeros(len(cache.key))
        cache.total[at], cache.log_alpha[at] = model.weights(j, sums)
        # weights by the routes that the n-grams were dealt by: the caches of lower orders
        found = _weights(made, sc.broadcast(model), j)
        model.remember(j, _frequent(made, j, _at_least(histogram, hot)))
        tables = tables.unionByName(made.where(F.col("kind") == j)).unionByName(found)
    return model, tables


def _small(c: int) -> np.dtype:
    return np.dtype(np.uint16 if c < 1 << 16 else np.uint32)


def score(docs: DataFrame, model: Model, tables: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind, n = docs.schema["doc_id"].dataType.simpleString(), model.n

    def ask(batches):
        m = sent.value
        word = m.cache[1]
        adds = {j: c.value() for j, c in m.cache.items()}
        adds[1] = word.log_p + (word.log_alpha if len(word.log_alpha) else 0.0)
        base_of = np.log10(word.count + 0.5)
        # before a text there are ends only: their log alpha as a history of each higher order
        start = 0.0
        for j in range(2, m.order):
            at, there = m.cached([np.array([END], np.uint64)] * j)
            start += float(m.cache[j].log_alpha[at[0]]) if there[0] and len(m.cache[j].log_alpha) else 0.0
        for number, ids, held_out, hashes, sizes in _texts(batches):
            doc = np.repeat(np.arange(len(sizes)), sizes)
            codes = m.codes(hashes)
            at, there = m.cached([codes])
            gain = np.where(there, adds[1][at], 0.0)
            base = np.where(there, base_of[at], 0.0)
            known = there & (word.count[at] > 0)
            asked = [(1, [codes[~there]], doc[~there])]
            for j in range(2, m.order + 1):
                columns = m.grams(codes, sizes, j)
                at, there = m.cached(columns)
                gain += np.where(there, adds[j][at], 0.0)
                asked.append((j, [c[~there] for c in columns], doc[~there]))
            sums = [np.bincount(doc, x, len(sizes)) for x in (gain, base, known.astype(float))]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (t := pa.table({"doc_id": ids, "held_out": pa.array(held_out), "n": pa.array(sizes), "gain": pa.array(sums[0] + start), "base": pa.array(sums[1]), "known": pa.array(sums[2])})).schema) as to:
                to.write_table(t)
            rows = [(-1 - number % n, 0, number, sink.getvalue().to_pybytes())]
            small = _small(len(sizes))
            for j, columns, of in asked:
                where = _bucket(m.route(columns), n)
                by = _in_order(columns, where)
                columns, of = [c[by] for c in columns], of[by].astype(small)
                rows += [(b, ASKED + j, number, _packed([c[part] for c in columns], of[part])) for b, part in _dealt(where[by], n)]
            yield _rows(rows)

    def answer(batches):
        m = sent.value
        for bucket, kinds in _gathered(batches, "bucket"):
            tables = Tables(m)
            for kind, blocks in kinds:
                if bucket < 0:
                    for number, data in blocks:
                        yield _rows([(0, 0, number, data)])
                elif kind < ASKED:
                    tables.take(kind, blocks)
                else:
                    for number, data in blocks:
                        *columns, of = _unpacked(data)
                        if kind == ASKED + 1:
                            c = tables.word_counts(columns[0])
                            values = [m.log_word(c) + tables.history(columns)[1], np.log10(c + 0.5), (c > 0).astype(float)]
                        else:
                            values = [tables.value(columns)]
                        size = int(of.max()) + 1
                        sums = [np.bincount(of, v, size) for v in values]
                        some = np.flatnonzero(np.logical_or.reduce([x != 0 for x in sums]))
                        if len(some):
                            yield _rows([(0, kind, number, _squeeze(some.astype(_small(size)), *(x[some] for x in sums)))])

    def add(batches):
        m = sent.value
        norm = np.log10(m.total + 0.5 * (m.distinct + 1))
        for _, kinds in _gathered(batches, "batch"):
            table = gain = base = known = None
            for kind, blocks in kinds:
                for _, data in blocks:
                    if kind == 0:
                        table = pa.ipc.open_stream(data).read_all()
                        gain, base, known = (table.column(c).to_numpy().copy() for c in ("gain", "base", "known"))
                        continue
                    doc, first, *more = _spread(data)
                    gain[doc] += first
                    if more:
                        base[doc] += more[0]
                        known[doc] += more[1]
            size = table.column("n").to_numpy()
            yield pa.record_batch(
                [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(size), pa.array(known.astype(np.int64)), pa.array(np.full(len(size), m.total)), pa.array(base - size * norm), pa.array(gain)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    asked = _by_bucket(tables.unionByName(docs.mapInArrow(tidy(ask), EXCHANGED)), n)
    return _by_bucket(asked.mapInArrow(tidy(answer), EXCHANGED), n, "batch").mapInArrow(tidy(add), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_scores(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot_words: int = HOT_WORDS, hot: int = HOT, few: int = FEW) -> DataFrame:
    """Learn from the rows where ``held_out`` is false; score all."""
    if order < 2:
        raise ValueError("an n-gram has two words or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, tables = train(rows, buckets(spark, input_bytes(docs), BUCKET_BYTES), order, hot_words, hot, few)
    return score(rows, model, tables)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir), crc_mod("doc_id", 5) == 1)
