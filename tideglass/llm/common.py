"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most BATCH_ROWS rows and BATCH_BYTES bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and the master is local (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tideglass-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors, is read again in columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of written() that are still there.
_WRITTEN: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.remove(path)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and no later plan reads."""
    read = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    for path in [x for x in _WRITTEN if os.path.basename(x) in read]:
        _delete(df.sparkSession, path)


def held_tables() -> frozenset[str]:
    """The tables of written() at this moment, for sweep()."""
    return frozenset(_WRITTEN)


def sweep(spark: SparkSession, before: frozenset[str], *keep: DataFrame) -> None:
    """Delete what written() made since ``before`` and no later plan reads, but for the tables in ``keep``."""
    kept = {os.path.basename(os.path.dirname(f)) for df in keep for f in df.inputFiles()}
    for path in [x for x in _WRITTEN if x not in before and os.path.basename(x) not in kept]:
        _delete(spark, path)


def buckets(spark: SparkSession, size: float, each: float, most: int = 20_000) -> int:
    """Partitions for an exchange of ``size`` (rows or bytes) at ``each`` of them: the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, int(size / each)), 1)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's bytes; 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them, cut so that no key is split; a key's parts are joined once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if held and now[0][-1] == held[-1][0][-1]:  # the key goes on
            held.append(now)
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        held.append([x[:last] for x in now])
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(whole[0]):
            yield whole
        held = [[x[last:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of a key as text, modulo n: the folds of the contracts.  A null key is in fold -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def columns(schema: pa.Schema, *values: Iterable) -> pa.RecordBatch:
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


class HashOf(dict):
    """Word -> XXH64, kept for words seen before; it starts anew beyond ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 120_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return got


_HASHES: dict[int, HashOf] = {}


def hash_words(docs: Iterable[list[bytes]], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word of every document, end to end, and the number of words of each.  Words are held one document at a time."""
    of = _HASHES.setdefault(seed, HashOf(seed=seed)).__getitem__
    parts = [np.fromiter(map(of, words), np.uint64, len(words)) for words in docs]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(x) for x in parts], np.int64)


#: What other modules keep between batches, and how to let it go.
KEPT: list[Callable[[], None]] = [lambda: [x.clear() for x in _HASHES.values()]]


def release() -> None:
    """Give a worker's memory back: a reused worker must not hold the words of one operator while it runs the next."""
    for drop in KEPT:
        drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def released(fit: Callable) -> Callable:
    """The same function, after which the driver gives the memory of its working set back."""

    @functools.wraps(fit)
    def held(*args, **kwargs):
        try:
            return fit(*args, **kwargs)
        finally:
            release()

    return held


def within(rows: DataFrame, column: str, most: int) -> DataFrame:
    """Rows of a written table whose ``column`` has about ``most`` bytes together at most: all of them, or a share chosen by a hash of the bytes."""
    size = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return rows if size <= most else rows.where(F.pmod(F.xxhash64(column, F.lit(29)), F.lit(1 << 24)) < int(most / size * (1 << 24)))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, and the worker's memory is released at the end of each task."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return held


def crc_unsigned(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def sliced(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes at most (one row is never split)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // most)))
        step = -(-batch.num_rows // parts)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
