"""Data quality: schema checks, gaps, stale runs, outliers, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Trail, ln, ratio

# Split factors that a price jump is compared with.
SPLIT_FACTORS = (2.0, 3.0, 4.0, 5.0, 8.0, 10.0, 20.0)


def violations(bars: DataFrame) -> DataFrame:
    """Counts of rows that break the schema, for each ticker; one aggregate."""
    prices = ("open", "high", "low", "close")
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c) <= 0).alias(f"bad_{c}") for c in prices],
        F.count_if(F.col("volume") < 0).alias("bad_volume"),
        F.count_if(F.col("high") < F.col("low")).alias("crossed"),
        (F.count("date") - F.countDistinct("date")).alias("repeated"),
    )


def validate(bars: DataFrame) -> DataFrame:
    """The rows, or an error that names the first broken ticker."""
    for row in violations(bars).orderBy("ticker").collect():  # a row for each ticker
        bad = {k: v for k, v in row.asDict().items() if k not in ("ticker", "rows") and v}
        if bad:
            raise ValueError(f"{row.ticker}: {bad}")
    return bars


def stale_runs(g: DataFrame, value: str = "close", by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The longest run of equal consecutive known values: 1 without repeats, 0 without values."""
    known = g.where(F.col(value).isNotNull())
    o = Window.partitionBy(*by).orderBy("session_id")
    changed = known.withColumn("__c", (~F.col(value).eqNullSafe(F.lag(value).over(o))).cast("int")).withColumn("__run", F.sum("__c").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    longest = changed.groupBy(*by, "__run").count().groupBy(*by).agg(F.max("count").alias("run"))
    return g.select(*by).distinct().join(longest, list(by), "left").select(*by, F.coalesce("run", F.lit(0)).alias("run"))


def returns_with_mad(g: DataFrame) -> DataFrame:
    """r, med and mad (scaled) of each ticker's log returns: two exact medians, in two passes of small rows."""
    t = Trail()
    r = g.withColumn("r", t.diff(ln("close")))
    med = r.groupBy("ticker").agg(F.percentile("r", F.lit(0.5)).alias("med"))
    dev = r.join(med, "ticker")
    mad = dev.groupBy("ticker").agg((F.percentile(F.abs(F.col("r") - F.col("med")), F.lit(0.5)) * 1.4826).alias("mad"))
    return dev.join(mad, "ticker")


def outliers(g: DataFrame, sigmas: float = 10.0) -> DataFrame:
    d = returns_with_mad(g)
    return d.where((F.col("mad") > 0) & (F.abs(F.col("r") - F.col("med")) > sigmas * F.col("mad"))).select("ticker", "session_id", "date", "r")


def ticker_quality(g: DataFrame, sigmas: float = 10.0) -> DataFrame:
    """first, last, expected and missing sessions, stale run, outliers of each ticker."""
    w = Window.partitionBy("ticker")
    live = g.withColumns({"lo": F.min(F.when(F.col("close").isNotNull(), F.col("session_id"))).over(w), "hi": F.max(F.when(F.col("close").isNotNull(), F.col("session_id"))).over(w)}).where(F.col("session_id").between(F.col("lo"), F.col("hi")))
    base = live.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("expected"), F.count_if(F.col("close").isNull()).alias("missing"))
    flagged = outliers(live, sigmas).groupBy("ticker").agg(F.count(F.lit(1)).alias("outliers"))
    return base.join(stale_runs(live), "ticker").join(flagged, "ticker", "left").fillna(0, ["outliers"])


def split_check(g: DataFrame, day: str, factor: float) -> DataFrame:
    """Ratios of close, open and 20-session median volume on both sides of a day; passed if within half the factor's log."""
    d = F.to_date(F.lit(day))
    back, on = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc())), F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    before = g.where(F.col("date") < d).withColumn("k", back).where("k <= 20").groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("c0"), F.percentile("volume", F.lit(0.5)).alias("v0"))
    after = g.where(F.col("date") >= d).withColumn("k", on).where("k <= 20").groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("c1"), F.max(F.when(F.col("k") == 1, F.col("open"))).alias("o1"), F.percentile("volume", F.lit(0.5)).alias("v1"))
    out = before.join(after, "ticker").select("ticker", ratio(F.col("c1"), F.col("c0")).alias("close_ratio"), ratio(F.col("o1"), F.col("c0")).alias("open_ratio"), ratio(F.col("v1"), F.col("v0")).alias("volume_ratio"))
    near = lambda c: F.coalesce(F.abs(ln(c)) < math.log(factor) / 2, F.lit(False))
    return out.withColumn("passed", near("close_ratio") & near("open_ratio") & near("volume_ratio"))


def suspect_splits(g: DataFrame, factors: tuple[float, ...] = SPLIT_FACTORS) -> DataFrame:
    """Days whose close jumps by about a split factor while volume shifts the other way."""
    t = Trail()
    jump = F.exp(-F.col("r"))
    near: Column = F.lit(False)
    for f in factors:
        near = near | (F.abs(ln(jump) - math.log(f)) < 0.05)
    rows = g.withColumns(
        {
            "r": t.diff(ln("close")),
            "vb": F.percentile("volume", F.lit(0.5)).over(t.window.rowsBetween(-20, -1)),
            "va": F.percentile("volume", F.lit(0.5)).over(t.window.rowsBetween(0, 19)),
        }
    )
    return rows.where((F.abs("r") > math.log(1.8)) & near & (F.col("vb") > 0) & (F.abs(ln(F.col("va") / F.nullif(F.col("vb"), F.lit(0.0))) - ln(jump)) < math.log(1.5))).select("ticker", "session_id", "date", "r")


def report(g: DataFrame, sigmas: float = 10.0, stale_limit: int = 5) -> dict:
    """The quality report as a dictionary: a row for each ticker, nothing larger, is collected."""
    rows = [r.asDict() for r in ticker_quality(g, sigmas).orderBy("ticker").collect()]
    dates: dict[str, list[str]] = {}
    w = Window.partitionBy("ticker").orderBy("session_id")
    for r in outliers(g, sigmas).withColumn("k", F.row_number().over(w)).where("k <= 20").orderBy("ticker", "session_id").collect():
        dates.setdefault(r.ticker, []).append(str(r.date))
    for r in rows:
        r |= {"first": str(r["first"]), "last": str(r["last"]), "outlier_dates": dates.get(r["ticker"], [])}
    return {"tickers": rows, "stale": [r["ticker"] for r in rows if r["run"] >= stale_limit], "splits": [r.asDict() | {"date": str(r.date)} for r in suspect_splits(g).orderBy("ticker", "session_id").limit(200).collect()]}


def report_markdown(rep: dict) -> str:
    head = "| ticker | first | last | expected | missing | longest stale run | outliers |\n| --- | --- | --- | --- | --- | --- | --- |\n"
    return "# Data quality\n\n" + head + "".join(f"| {r['ticker']} | {r['first']} | {r['last']} | {r['expected']} | {r['missing']} | {r['run']} | {r['outliers']} |\n" for r in rep["tickers"])
