"""Queries that must read every row: brute force on the same tables."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from tideglass.plans import all_queries  # noqa: F401
from tideglass.plans.query import QUERIES
from tideglass.sources import market, store


def test_hash_of_all_orders(spark, sf_dir):
    o = pd.read_parquet(f"{sf_dir}/orders.parquet").sort_values("o_orderkey")
    parts = {}
    for k, status, cust in zip(o.o_orderkey, o.o_orderstatus, o.o_custkey, strict=True):
        parts.setdefault(k // 1000, []).append(f"{k}:{hashlib.sha256(f'{status}{cust}'.encode()).hexdigest()}")
    digests = [hashlib.sha256("\n".join(parts[p]).encode()).hexdigest() for p in sorted(parts)]
    assert len(parts) > 1
    assert QUERIES["k03_data_hash_all"].run(spark, sf_dir).first().data_hash == hashlib.sha256("\n".join(digests).encode()).hexdigest()[:12]


def test_any_row_changes_the_hash(spark):
    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    of = lambda df: store.data_hash_by_range(df, "id").first().data_hash
    one = of(rows)
    assert one == of(rows.repartition(5)) and all(of(rows.withColumn("sha256", F.when(F.col("id") == k, "x").otherwise(F.col("sha256")))) != one for k in (1, 1500, 2999))


def test_whole_grid_is_sorted_and_united(spark, sf_dir):
    grid = sorted((r.date, r.ticker, r.session_id) for r in market.grid(spark, sf_dir).select("date", "ticker", "session_id").collect())
    got = sorted(tuple(r) for r in QUERIES["o01_sorted_all"].run(spark, sf_dir).collect())
    assert got == [(k + 1, ticker, session) for k, (_, ticker, session) in enumerate(grid)]
    both = sorted(tuple(r) for r in QUERIES["o05_union_all_whole"].run(spark, sf_dir).collect())
    assert both == sorted([(t, s) for _, t, s in grid] * 2)
