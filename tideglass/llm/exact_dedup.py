"""Exact dedup by a heavy-hitter split.

Texts are equal when identical after deleting ASCII white space.  One pass
writes a narrow digest table; Misra-Gries summaries of it name at most ``k``
digests that can hold more than a 1/k share of the rows.  Those are counted
exactly, and the groups that really are that large (k at most, hence a proven
bound) are broadcast: their rows are resolved where they lie.  All other
digests take the ordinary shuffle, where no key has more than 1/k of the rows.

Defined results: a null text is the empty text; empty texts equal each other;
of equal texts the one with most code points, then the smallest doc_id (null
last), stays; in the marks, rows of one text that repeat a doc_id share its
result, and deduplicate() keeps one of them; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, tidy, written

WHITE = r"[\x20\x09-\x0D]"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("n_cp"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256)).alias("digest"),
    )


def _cut(counts: Counter, k: int) -> Counter:
    """Misra-Gries: keep the k largest counters, less the (k+1)-th count."""
    if len(counts) <= k:
        return counts
    top = counts.most_common(k + 1)
    less = top[k][1]
    return Counter({x: n - less for x, n in top[:k] if n > less})


def _summarise(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: Counter = Counter()
        for batch in batches:
            got = batch.column(0).value_counts()
            seen.update(dict(zip(got.field(0).to_pylist(), got.field(1).to_pylist(), strict=True)))
            if len(seen) > 16 * k:
                seen = _cut(seen, k)
        seen = _cut(seen, k)
        if seen:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()] * len(seen), pa.int64()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["part", "digest", "n"])

    return run


def heavy_digests(table: DataFrame, k: int = 1024, fan_in: int = 64) -> list[bytes]:
    """Digests that can hold over 1/k of the rows: k at most, merged in a tree of ``fan_in`` summaries a task."""
    spark = table.sparkSession
    bounded_batches(spark)
    kind = "part long, digest binary, n long"
    out = table.select("digest").mapInArrow(tidy(_summarise(k)), kind)
    parts = table.rdd.getNumPartitions()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        for digest, n in zip(pdf["digest"], pdf["n"], strict=True):
            seen[bytes(digest)] += n
        seen = _cut(seen, k)
        return pd.DataFrame({"part": [key[0]] * len(seen), "digest": list(seen), "n": list(seen.values())})

    while parts > fan_in:
        out = out.withColumn("part", F.floor(F.col("part") / fan_in).cast("long")).groupBy("part").applyInPandas(merge, kind)
        parts = -(-parts // fan_in)
    total: Counter = Counter()
    for row in out.select("digest", "n").collect():  # fan_in * k rows at most
        total[bytes(row.digest)] += row.n
    return list(_cut(total, k))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    spark = docs.sparkSession
    table = written(digests(docs, id_col, text_col))
    best = F.min_by("doc_id", F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), F.col("doc_id")))
    group = [best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = spark.createDataFrame([(x,) for x in heavy_digests(table, k)], "digest binary")
    winners = table.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(*group).collect()  # k rows at most
    n = table.count()
    winners = spark.createDataFrame([tuple(r) for r in winners if r.group_size > n / k], f"digest binary, keep_id {dict(table.dtypes)['doc_id']}, group_size long")
    large = table.join(F.broadcast(winners), "digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    small = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return large.unionByName(small).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """The rows that stay, with all their columns: one of each text, whatever other rows share its doc_id."""
    marked = written(mark(docs, id_col, text_col, k).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"))
    sha = F.sha2(F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), WHITE, "").cast("binary"), 256)
    same = lambda other: docs[id_col].eqNullSafe(other["__id"]) & (sha == other["__sha"])
    # rows that repeat both the text and the doc_id that stays: the longest of them, then by its text
    twice = marked.where("kept").groupBy("__id", "__sha").count().where("count > 1").select("__id", "__sha")
    gone = marked.where(~F.col("kept")).select("__id", "__sha").distinct().unionByName(twice)
    size = F.struct(F.char_length(F.coalesce(docs[text_col], F.lit(""))), docs[text_col])
    rows = docs.join(twice, same(twice)).groupBy("__sha").agg(F.max_by(F.struct(*[docs[c] for c in docs.columns]), size).alias("__row"))
    return docs.join(gone, same(gone), "left_anti").unionByName(rows.select("__row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(documents(spark, sf_dir))


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
