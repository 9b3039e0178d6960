"""SimHash near-dedup with multi-index hashing.

A fingerprint has 64 bits; two are linked at ``radius`` 3 or fewer differing
bits.  It is split into two 32-bit segments: if three bits differ, one segment
differs in at most one.  So each distinct fingerprint is stored in two tables
under its segments, and looked up under the Hamming ball of radius 1 around
each segment; candidates are verified on all 64 bits.  A pair whose segments
differ by one bit is met from the side that has the bit set, so the ball needs
only those flips.  Copies collapse to one fingerprint before any lookup, and a
table bucket yields a spanning forest of its links, never all pairs.

A bucket in which over ``CROWDED`` fingerprints are stored is indexed once
more by its other segment, in two halves: at three bits or fewer one half
differs in at most one, so the ball of radius 1 around each half finds all.
Such a smaller bucket has three quarters of its bits fixed and holds 65,536
fingerprints at most, whatever the table.

Defined results: null and empty texts have fingerprint zero and are linked
like any other; fewer words than a shingle make one shingle; rows repeating a
doc_id are separate rows with equal results; ids are integers below 2^62, and
a group without any id has component null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, buckets, by_key, documents, sliced, text_bytes, tidy, written
from .components import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Numbers from here on stand for fingerprints of rows without an id.
NO_ID = 1 << 62
#: Stored fingerprints of a bucket from which on it is indexed by its other segment too.
CROWDED = 8_192


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of every shingle of a text whose A-Z are lower-cased, repeats included."""
    got = text.lower().split()
    if not got:
        return []
    line = b" ".join(got)
    if len(got) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(line)]
    return list(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts, ends[words - 1 :])), repeat(SEED)))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bit i is 1 if set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(x, words) for x in text_bytes(batch.column(1))], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp long")


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a boolean matrix left x right, without those that close a cycle."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in np.argwhere(near):
        a, b = int(left[i]), int(right[j])
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            yield a, b


def _bucket_links(stored: np.ndarray, asking: np.ndarray, radius: int, block: int = 1024) -> Iterator[tuple[int, int]]:
    """Verified links of one bucket: stored with stored, and asking with stored; in blocks, so memory is bounded."""
    for i in range(0, len(stored), block):
        left = stored[i : i + block]
        for other, start in ((stored, i), (asking, 0)):
            for j in range(start, len(other), block):
                right = other[j : j + block]
                yield from _forest(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius, left, right)


def _links(radius: int):
    """Rows (key, fp, stored) sorted by key -> verified links (a, b) of fingerprints."""

    def bucketed(key: np.ndarray, fp: np.ndarray, stored: np.ndarray) -> Iterator[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        held = np.add.reduceat(stored.astype(np.int64), starts)
        for k in np.flatnonzero((held > 0) & (ends - starts > 1)):
            part, mine = fp[starts[k] : ends[k]].view(np.uint64), stored[starts[k] : ends[k]]
            yield from _bucket_links(part[mine], part[~mine], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in by_key(batches):
            got = np.array(list(bucketed(*columns)), np.uint64).reshape(-1, 2).view(np.int64)
            if len(got):
                yield pa.record_batch([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])

    return run


def _flips(value: F.Column, bits: int, set_only: bool) -> F.Column:
    """The value with each of its bits flipped in turn, or only with each set bit cleared."""
    masks = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) != 0) if set_only else masks, lambda m: value.bitwiseXOR(m))


def _indexed_again(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, stored) of crowded buckets -> the same under smaller keys: the bucket with a half of the other segment, asked for under its ball too.

    Equal hashes of different smaller keys only make more candidates, which are verified.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    other = F.when(F.shiftrightunsigned("key", 32) > 0, F.shiftrightunsigned("fp", 32)).otherwise(low)  # the low segment's keys carry bit 32
    halves = [(F.lit(0), F.shiftrightunsigned(other, 16)), (F.lit(1), other.bitwiseAND(F.lit(0xFFFF)))]
    smaller = lambda of: F.array(*[F.struct(which.alias("which"), half.alias("half")) for which, half in of])
    stored = rows.where("stored").select("key", "fp", "stored", F.explode(smaller(halves)).alias("at"))
    # stored fingerprints ask as well: their own segment is equal, the other need not be
    marked = lambda which: lambda half: F.struct(which.alias("which"), half.alias("half"))
    balls = F.concat(*[F.transform(_flips(half, 16, False), marked(which)) for which, half in halves])
    exact = rows.where(~F.col("stored")).select("key", "fp", "stored", F.explode(smaller(halves)).alias("at"))
    around = rows.select("key", "fp", F.lit(False).alias("stored"), F.explode(balls).alias("at"))
    return stored.unionByName(exact).unionByName(around).select(F.xxhash64("key", "at.which", "at.half").alias("key"), "fp", "stored")


def links(distinct: DataFrame, radius: int = RADIUS, fp_col: str = "fp", crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that connect what pairs of distinct fingerprints within ``radius`` 3 bits connect.  ``distinct`` is a written table."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 find links of 3 bits or fewer")
    spark = distinct.sparkSession
    fp = F.col(fp_col)
    halves = [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))]
    stored = distinct.select(F.explode(F.array(*halves)).alias("key"), fp.alias("fp"), F.lit(True).alias("stored"))
    asking = distinct.select(F.explode(F.concat(*[_flips(h, 32, True) for h in halves])).alias("key"), fp.alias("fp"), F.lit(False).alias("stored"))
    # the low segment's mark, bit 32, is none of its bits, so no flip clears it
    full = written(stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key"))
    n = buckets(spark, distinct.count(), 100_000)

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(_links(radius)), "a long, b long")

    if not full.take(1):
        return met(stored.unionByName(asking)).distinct()
    rows = stored.unionByName(asking)
    return met(rows.join(full, "key", "left_anti")).unionByName(met(_indexed_again(rows.join(full, "key", "left_semi")))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    bounded_batches(docs.sparkSession)
    table = written(fingerprints(docs, id_col, text_col, words))
    # a node is known by its smallest id, so the least node of a component is the answer and no component is gathered;
    # a fingerprint without any id gets a number above all ids (two that share one differ in two bits, hence are linked)
    stand_in = F.shiftrightunsigned("fp", 2).bitwiseOR(F.lit(NO_ID))
    nodes = written(table.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.first(stand_in)).alias("node")))
    found = written(links(nodes, radius))
    ends = [nodes.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}")) for c in "ab"]
    joined = components(found.join(ends[0], "a").join(ends[1], "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    named = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return table.join(named, "fp").select("doc_id", "fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows whose doc_id is the smallest of their group, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col, words, radius).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
