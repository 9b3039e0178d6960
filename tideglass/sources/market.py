"""OHLCV bars on one session calendar, from a table of trades.

A trade is a line item: price = extended price / quantity, day = ship date.
Tickers are the return flags, and ``ALL`` pools them.  The scan is aggregated
once to (flag, day), with map-side partial aggregation; the pooled ticker is
rolled up from those rows.  The grid adds one scan of two columns for its axes.
All later windows run on (ticker, session) rows, whose number is bounded by the
calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TARGET, PEERS = "ALL", ("A", "N", "R")
#: Peers that stand in for a sector fund, a broad fund and an index.
SECTOR, BROAD, INDEX = "A", "N", "R"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("seq"),
        "l_discount",
        "l_tax",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open, high, low, close, volume: days with trades only."""
    by_flag = (
        trades(spark, sf_dir)
        .groupBy(F.col("flag").alias("ticker"), "date")
        .agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
            F.sum("qty").alias("volume"), F.min("seq").alias("first"), F.max("seq").alias("last"),
        )
    )
    # the flag and the pool are two tickers of one small table, so the trades have one reader
    both = by_flag.withColumn("ticker", F.explode(F.array("ticker", F.lit(TARGET))))
    return both.groupBy("ticker", "date").agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume")
    )


def sessions(days: DataFrame) -> DataFrame:
    """session_id, date: the distinct days in order (a calendar: some thousands of rows at any input size)."""
    return days.select("date").distinct().withColumn("session_id", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def on_grid(b: DataFrame) -> DataFrame:
    """Bars on the dense grid of sessions and tickers; missing bars are null."""
    # both axes from one narrow scan: days (a calendar) and names, as two arrays; a day's place is its session
    axes = b.select("ticker", "date").agg(F.array_sort(F.collect_set("date")).alias("days"), F.collect_set("ticker").alias("names"))
    cells = axes.select("days", F.explode("names").alias("ticker")).select("ticker", F.posexplode("days").alias("session_id", "date"))
    return cells.join(b, ["ticker", "date"], "left").select("ticker", F.col("session_id").cast("long").alias("session_id"), "date", "open", "high", "low", "close", "volume")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_grid(bars(spark, sf_dir))


def target(spark: SparkSession, sf_dir: str, name: str = TARGET) -> DataFrame:
    return grid(spark, sf_dir).where(F.col("ticker") == name)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, vix, vix3m, dgs10, dgs2: daily analogues of volatility indices and rates."""
    return trades(spark, sf_dir).groupBy("date").agg(
        F.stddev_samp("price").alias("vix"), F.avg("price").alias("vix3m"), (100 * F.avg("l_discount")).alias("dgs10"), (100 * F.avg("l_tax")).alias("dgs2")
    )


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, timing: the first order day of each month and priority; urgent and high ones come before the open."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    return (
        o.groupBy(F.trunc("date", "MM").alias("month"), "o_orderpriority")
        .agg(F.min("date").alias("date"))
        .select("date", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "bmo").otherwise("amc").alias("timing"))
        .distinct()
    )


# The same tables as SQL, for the oracles.
TRADES_SQL = """
trades AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS qty,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq, l_discount, l_tax FROM lineitem)"""
BARS_SQL = f"""{TRADES_SQL},
tagged AS (SELECT flag AS ticker, * FROM trades UNION ALL SELECT 'ALL' AS ticker, * FROM trades),
bars AS (SELECT ticker, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume FROM tagged GROUP BY ticker, date),
sessions AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_id FROM (SELECT DISTINCT date FROM trades))"""
GRID_SQL = f"""{BARS_SQL},
grid AS (SELECT t.ticker, s.session_id, s.date, b.open, b.high, b.low, b.close, b.volume
  FROM sessions s CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = s.date)"""
MACRO_SQL = "macro AS (SELECT date, stddev_samp(price) AS vix, avg(price) AS vix3m, 100 * avg(l_discount) AS dgs10, 100 * avg(l_tax) AS dgs2 FROM trades GROUP BY date)"
EVENTS_SQL = """
event_days AS (SELECT DISTINCT date, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'bmo' ELSE 'amc' END AS timing
  FROM (SELECT date_trunc('month', o_orderdate) AS m, o_orderpriority, min(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY 1, 2))"""
