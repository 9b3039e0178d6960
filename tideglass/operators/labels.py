"""Forward labels, barriers and sample weights.  The only place that looks ahead."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Ahead, Trail, ln


def forward_returns(g: DataFrame, horizons: tuple[int, ...] = (1, 5, 21), sigma: Column | None = None) -> DataFrame:
    """fwd_ret_h = ln(open[t+1+h] / open[t+1]), its end t_end_h, and, with ``sigma``, fwd_ret_vn_h in units of sigma sqrt(h)."""
    a = Ahead()
    out: dict[str, Column] = {}
    for h in horizons:
        out[f"fwd_ret_{h}"] = a.lead(ln("open"), 1 + h) - a.lead(ln("open"), 1)
        out[f"t_end_{h}"] = a.lead("session_id", 1 + h)
        if sigma is not None:
            out[f"fwd_ret_vn_{h}"] = F.try_divide(out[f"fwd_ret_{h}"], F.nullif(sigma, F.lit(0.0)) * math.sqrt(h))
    return g.withColumns(out)


def holding_return(price: str = "open") -> Column:
    """Log return of a position decided at t: from t+1 to t+2 at the given price."""
    a = Ahead()
    return a.lead(ln(price), 2) - a.lead(ln(price), 1)


def triple_barrier(g: DataFrame, sigma: str = "sigma", up: float = 1.0, down: float = 1.0, vertical: int = 10) -> DataFrame:
    """tb_label, tb_ret, tb_end, tb_barrier of rows (ticker, session_id, open, sigma).

    Entry is the next open; the first later open at or beyond a barrier of
    mult * sigma * sqrt(vertical) decides, or the last one, by its sign.  The
    path is an array of the next opens: no join, no Python.
    """
    a = Ahead()
    width = F.col(sigma) * math.sqrt(vertical)
    path = F.transform("__path", lambda x: x["p"] - F.col("__entry"))
    rows = g.withColumns(
        {
            "__path": F.collect_list(F.struct(F.col("session_id").alias("s"), ln("open").alias("p"))).over(a.rows(2, vertical + 1)),
            "__entry": a.lead(ln("open"), 1),
            "tb_barrier": width,
        }
    )
    rows = rows.withColumn("__full", (F.size("__path") == vertical) & F.col("__entry").isNotNull() & F.col("tb_barrier").isNotNull())
    rows = rows.withColumn("__rel", F.when(F.col("__full"), path))
    first = lambda test: F.array_position(F.transform("__rel", lambda x: F.coalesce(test(x), F.lit(False))), True)
    rows = rows.withColumns({"__up": first(lambda x: x >= up * F.col("tb_barrier")), "__dn": first(lambda x: x <= -down * F.col("tb_barrier"))})
    none = F.lit(vertical + 1)
    u, d = (F.when(F.col(c) > 0, F.col(c)).otherwise(none) for c in ("__up", "__dn"))
    k = F.when(u != d, F.least(u, d)).otherwise(F.lit(vertical)).cast("int")
    rows = rows.withColumn("__k", F.when(F.col("__full"), k))
    ret = F.when(F.col("__full"), F.element_at("__rel", F.col("__k")))
    label = F.when(F.col("__full"), F.when(u < d, 1.0).when(d < u, -1.0).otherwise(F.signum(ret)))
    rows = rows.withColumns({"tb_ret": ret, "tb_label": label, "tb_end": F.when(F.col("__full"), F.col("session_id") + 1 + F.col("__k"))})
    return rows.drop("__path", "__entry", "__full", "__rel", "__up", "__dn", "__k")


def meta_label(side: Column, ret: Column) -> Column:
    """1 if the side taken would have earned, 0 if not; null where flat or unknown."""
    return F.when((side != 0) & ret.isNotNull(), (side * ret > 0).cast("int"))


def average_uniqueness(samples: DataFrame, days: DataFrame, end: str = "t_end", by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """samples (by, session_id, end) with ``uniqueness``: the mean of 1 / concurrency over the sessions a label covers.

    Concurrency is a running sum of +1 and -1 events and the mean a difference
    of prefix sums, so no interval is exploded.
    """
    first, last = F.col("session_id") + 1, F.col(end) - 1
    live = samples.where(last >= first)
    marks = live.select(*by, first.alias("u"), F.lit(1).alias("d")).unionByName(live.select(*by, (last + 1).alias("u"), F.lit(-1).alias("d"))).groupBy(*by, "u").agg(F.sum("d").alias("d"))
    grid = samples.select(*by).distinct().crossJoin(F.broadcast(days.select(F.col("session_id").alias("u")).distinct()))
    w = Window.partitionBy(*by).orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    conc = grid.join(marks, [*by, "u"], "left").withColumn("c", F.sum(F.coalesce("d", F.lit(0))).over(w)).withColumn("inv", F.when(F.col("c") > 0, 1 / F.col("c")).otherwise(0.0))
    total = conc.select(*by, "u", F.sum("inv").over(w).alias("s"), "inv")
    begin = total.select(*by, F.col("u").alias("__b"), (F.col("s") - F.col("inv")).alias("s0"))
    finish = total.select(*by, F.col("u").alias("__e"), F.col("s").alias("s1"))
    rows = samples.withColumns({"__b": F.when(last >= first, first), "__e": F.when(last >= first, last)})
    out = rows.join(begin, [*by, "__b"], "left").join(finish, [*by, "__e"], "left")
    return out.withColumn("uniqueness", (F.col("s1") - F.col("s0")) / (F.col("__e") - F.col("__b") + 1)).drop("__b", "__e", "s0", "s1")


def rolling_sigma(t: Trail, span: int = 63) -> Column:
    return t.std("r", span)
