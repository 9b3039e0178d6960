"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8; a chunk ends where its masked value is
zero, with a stricter mask before the normal size and a looser one after it,
so sizes gather around the normal one, between a least and a most size.  The
fingerprint is the set of chunk digests with their lengths.  An edit moves
only the boundaries near it, so the likeness of two fingerprints, the length of
their common chunks over that of the smaller set, measures containment.

The gear hash has 32 bits, so a position's value depends on 32 bytes; it is
computed for whole batches at once by doubling, with 32 empty places between
texts, which is exactly the sequential hash started anew for each.

Neighbours: rows are dealt to ranges of the id (bounds from a bounded sample of
ids; their number follows the input's size), sorted, and read in order; each range gets one more row, the first
row of the next, so every row meets its successor without one task for all.

Defined results: a null text is the empty text; an empty text has the empty
fingerprint, like only another empty one (1) and nothing else (0); rows that
repeat an id follow each other by text; null ids come first; the last row's
successor is the first, a lone row's itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, buckets, documents, input_bytes, sliced, tidy

LEAST, NORMAL, MOST = 12, 40, 160
#: Hash bits that must be zero: six before the normal size, four of them after it.
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Estimated bytes of the input for each task of the range shuffle.
RANGE_BYTES = 32 << 20
WIDTH, SIZE = 12, 2  # hex digits of a digest and of a length


def gear(data: np.ndarray) -> np.ndarray:
    """The sequential gear hash at every place; empty places have the value 256 in ``data`` (uint16)."""
    h = np.concatenate([GEAR, [np.uint32(0)]]).astype(np.uint32)[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def boundaries(texts: list[bytes], least: int = LEAST, normal: int = NORMAL, most: int = MOST) -> Iterator[list[int]]:
    """The chunk ends of every text."""
    gap = 32
    starts = np.cumsum([0] + [len(x) + gap for x in texts])
    data = np.full(int(starts[-1]), 256, np.uint16)
    for at, x in zip(starts.tolist(), texts, strict=False):
        data[at : at + len(x)] = np.frombuffer(x, np.uint8)
    h = gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0]
    low, high = np.searchsorted(loose, starts), np.searchsorted(strict, starts)
    for k, x in enumerate(texts):
        n, at = len(x), int(starts[k])
        weak = (loose[low[k] : low[k + 1]] - at + 1).tolist() + [n + most]
        firm = (strict[high[k] : high[k + 1]] - at + 1).tolist() + [n + most]
        ends, cut, i, j = [], 0, 0, 0
        while cut < n:
            if n - cut <= least:
                cut = n
            else:
                first, middle, last = cut + least, cut + normal, min(cut + most, n)
                while firm[i] < first:
                    i += 1
                if firm[i] <= middle:
                    cut = min(firm[i], last)
                else:
                    while weak[j] <= middle:
                        j += 1
                    cut = min(weak[j], last)
            ends.append(cut)
        yield ends


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """Digest -> length of every chunk, for each text."""
    out = []
    digest = xxhash.xxh3_64_intdigest
    for x, ends in zip(texts, boundaries(texts), strict=True):
        out.append({digest(x[a:b]) >> 16: b - a for a, b in zip([0, *ends], ends, strict=False)})
    return out


def written_out(chunks: dict[int, int]) -> str:
    return "".join([f"{d:012x}{n:02x}" for d, n in sorted(chunks.items())])


def read_in(fingerprint: str) -> dict[int, int]:
    step = WIDTH + SIZE
    return {int(fingerprint[k : k + WIDTH], 16): int(fingerprint[k + WIDTH : k + step], 16) for k in range(0, len(fingerprint), step)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of common chunks over that of the smaller set."""
    if not a or not b:
        return float(not a and not b)
    common = sum(n for d, n in a.items() if d in b) if len(a) <= len(b) else sum(n for d, n in b.items() if d in a)
    return min(1.0, common / min(sum(a.values()), sum(b.values())))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = chunk_sets([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(map(written_out, found), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fingerprint string")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges_each: int = 4) -> DataFrame:
    """range, tail, doc_id, text: sorted in every task; a range's last row is the first of the next range (tail true)."""
    spark = docs.sparkSession
    n = buckets(spark, input_bytes(docs), RANGE_BYTES)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    many = n * ranges_each
    # bounds from at most about 20 ids for each range, as a range partitioner takes them
    total, want = ids.count(), 20 * many
    seen = np.sort((ids if total <= want else ids.sample(fraction=want / total, seed=1)).where("doc_id is not null").toArrow().column("doc_id").to_numpy())
    bounds = np.unique(seen[np.arange(1, many) * len(seen) // many]) if len(seen) else np.zeros(0, np.int64)

    def place(values: pa.Array) -> np.ndarray:
        known = values.fill_null(np.iinfo(np.int64).min).to_numpy()
        return np.searchsorted(bounds, known, "right")

    def firsts(batches):
        least: dict[int, int | None] = {}
        for batch in batches:
            got = place(batch.column(0))
            known = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            for r in np.unique(got).tolist():
                now = int(known[got == r].min())
                least[r] = min(now, least.get(r, now))
        yield pa.record_batch([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], names=["r", "least"])

    found = {r.r: r.least for r in ids.mapInArrow(tidy(firsts), "r long, least long").groupBy("r").agg(F.min("least").alias("least")).collect()}  # a row for each range
    order = sorted(found)
    before = {found[r]: order[k - 1] for k, r in enumerate(order)}  # first id of a range -> the range before it
    heads = np.array(sorted(before), np.int64)
    to = np.array([before[x] for x in heads.tolist()], np.int64)

    def deal(batches):
        for batch in batches:
            r = place(batch.column(0))
            known = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            yield pa.record_batch([pa.array(r), pa.array(np.zeros(len(r), bool)), batch.column(0), batch.column(1)], names=["range", "tail", "doc_id", "text"])
            some = np.flatnonzero(np.isin(known, heads))
            if len(some):
                rows = pa.array(some)
                yield pa.record_batch([pa.array(to[np.searchsorted(heads, known[some])]), pa.array(np.ones(len(some), bool)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["range", "tail", "doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(deal), "range long, tail boolean, doc_id long, text string").repartition(n, "range").sortWithinPartitions("range", "tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_at_once: int = 2 << 20) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def out(held: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in held] + [after]
        raw = [t.encode() for t in texts]
        changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
        sets = chunk_sets(raw + changed)
        own, new = sets[: len(held)], sets[len(held) + 1 :]
        return pa.record_batch(
            [
                pa.array([i for i, _ in held], pa.int64()),
                pa.array([len(t) for _, t in held], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
                pa.array(map(written_out, own), pa.string()),
                pa.array(map(written_out, new), pa.string()),
                pa.array(list(map(likeness, own, new)), pa.float64()),
                pa.array(list(map(likeness, own, sets[1 : len(held) + 1])), pa.float64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        at, size, done = None, 0, False
        for batch in sliced(batches):
            for r, tail, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at:
                    at, done = r, False
                if done:  # more rows with the first id of the next range
                    continue
                if tail or size > bytes_at_once:
                    if held:
                        yield out(held, text)
                    held, size = [], 0
                if tail:
                    done = True
                else:
                    held.append((i, text))
                    size += len(text)

    return in_order(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(documents(spark, sf_dir))
