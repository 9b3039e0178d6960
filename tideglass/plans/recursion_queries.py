"""Queries of ordered recursions; the exponential ones have recursive oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.windows import Trail, ln
from ..operators import labels as L
from ..operators import recursions as R
from ..sources import market as M
from .feature_queries import RANGES
from .label_queries import lead
from .portfolio_queries import forecasts, market_inputs
from .query import query

OWN = f"{RANGES}, own AS (SELECT *, row_number() OVER (ORDER BY session_id) AS n FROM ranges WHERE ticker = 'ALL')"


def ewm_sql(name: str, source: str, x: str, alpha: float, least: int) -> str:
    """A table (session_id, m) of the exponential mean of x, which may be null only at its head."""
    return f"""s_{name} AS (SELECT session_id, {x} AS x, row_number() OVER (ORDER BY session_id) AS k FROM {source} WHERE {x} IS NOT NULL),
r_{name} AS (SELECT k, session_id, x AS m FROM s_{name} WHERE k = 1 UNION ALL SELECT s.k, s.session_id, {1 - alpha!r} * r.m + {alpha!r} * s.x FROM r_{name} r JOIN s_{name} s ON s.k = r.k + 1),
{name} AS (SELECT session_id, CASE WHEN k >= {least} THEN m END AS m FROM r_{name})"""


@query("e01_ewm_mean", "session_id", "m", sql="/*recursive*/ SELECT o.session_id, e.m FROM own o LEFT JOIN e USING (session_id)", tables=f"{OWN}, {ewm_sql('e', 'own', 'close', 0.06, 26)}")
def _ewm(spark, sf):
    return R.ordered_scan(M.target(spark, sf).select("ticker", "session_id", "close"), ("ticker",), lambda p: {"m": R.ewm_mean(p["close"], 0.06, 26)}, {"m": "double"})


_A = 2 / 64
STD = f"""{OWN}, s_v AS (SELECT session_id, r AS x, row_number() OVER (ORDER BY session_id) AS k FROM own WHERE r IS NOT NULL),
r_v AS (SELECT k, session_id, x AS m, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS w1, CAST(1 AS DOUBLE) AS w2 FROM s_v WHERE k = 1 UNION ALL
  SELECT s.k, s.session_id, {1 - _A!r} * r.m + {_A!r} * s.x, {1 - _A!r} * (r.c + power(r.m - ({1 - _A!r} * r.m + {_A!r} * s.x), 2)) + {_A!r} * power(s.x - ({1 - _A!r} * r.m + {_A!r} * s.x), 2), {1 - _A!r} * r.w1 + {_A!r}, power({1 - _A!r}, 2) * r.w2 + power({_A!r}, 2)
  FROM r_v r JOIN s_v s ON s.k = r.k + 1),
sg AS (SELECT o.ticker, o.session_id, o.open, CASE WHEN v.k >= 63 THEN sqrt(v.c * v.w1 * v.w1 / (v.w1 * v.w1 - v.w2)) END AS sigma FROM own o LEFT JOIN r_v v USING (session_id))"""
query("e02_ewm_std", "session_id", "sigma", sql="/*recursive*/ SELECT session_id, sigma FROM sg", tables=STD)(lambda s, d: R.ex_ante_vol(M.target(s, d)))
query("l02_normalized_labels", "session_id", "fwd_ret_vn_1 fwd_ret_vn_5 fwd_ret_vn_21", sql="/*recursive*/ SELECT session_id, " + ", ".join(f"(ln({lead('open', 1 + h)}) - ln({lead('open')})) / nullif(sigma * sqrt({h}), 0) AS fwd_ret_vn_{h}" for h in (1, 5, 21)) + " FROM sg", tables=STD)(lambda s, d: L.forward_returns(R.ex_ante_vol(M.target(s, d)), sigma=F.col("sigma")))
query("m18_ewma_variance", "session_id", "var", sql="/*recursive*/ SELECT session_id, m AS var FROM e", tables=f"{OWN}, {ewm_sql('e', '(SELECT *, r * r AS r2 FROM own)', 'r2', 0.06, 1)}")(
    lambda s, d: R.ordered_scan(M.target(s, d).withColumn("lr", Trail().diff(ln("close"))).select("ticker", "session_id", "lr"), ("ticker",), lambda p: {"var": R.ewm_mean(p["lr"].to_numpy(float) ** 2, 0.06)}, {"var": "double"}).where("var is not null")
)
_D = "(SELECT *, close - lag(close) OVER (ORDER BY session_id) AS d FROM own)"
query("w14_rsi", "session_id", "rsi_14", sql="/*recursive*/ SELECT o.session_id, 1 - 1 / (1 + u.m / nullif(w.m, 0)) AS rsi_14 FROM own o LEFT JOIN u USING (session_id) LEFT JOIN w USING (session_id)", tables=f"{OWN}, {ewm_sql('u', f'(SELECT session_id, greatest(d, 0) AS p FROM {_D} WHERE d IS NOT NULL)', 'p', 1 / 14, 14)}, {ewm_sql('w', f'(SELECT session_id, greatest(-d, 0) AS p FROM {_D} WHERE d IS NOT NULL)', 'p', 1 / 14, 14)}")(lambda s, d: R.technical(M.target(s, d)))
query("w15_macd", "session_id", "macd_hist", sql="/*recursive*/ SELECT o.session_id, (x.macd - g.m) / o.close AS macd_hist FROM own o LEFT JOIN x USING (session_id) LEFT JOIN g USING (session_id)", tables=f"{OWN}, {ewm_sql('f', 'own', 'close', 2 / 13, 26)}, {ewm_sql('l', 'own', 'close', 2 / 27, 26)}, x AS (SELECT session_id, f.m - l.m AS macd FROM f JOIN l USING (session_id)), {ewm_sql('g', 'x', 'macd', 2 / 10, 9)}")(lambda s, d: R.technical(M.target(s, d)))
query("w17_atr", "session_id", "atr_14", sql="/*recursive*/ SELECT o.session_id, a.m / o.close AS atr_14 FROM own o LEFT JOIN a USING (session_id)", tables=f"{OWN}, {ewm_sql('a', '(SELECT session_id, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS t FROM (SELECT *, lag(close) OVER (ORDER BY session_id) AS p FROM own))', 't', 1 / 14, 14)}")(lambda s, d: R.technical(M.target(s, d)))
_FFD = R.ffd_weights(0.4, 1e-3, 100)
query("e03_fractional_difference", "session_id", "fd", sql="SELECT session_id, CASE WHEN count(close) OVER w = " + str(len(_FFD)) + " THEN " + " + ".join(f"{c!r} * ln(lag(close, {k}) OVER (ORDER BY session_id))" for k, c in enumerate(_FFD)) + f" END AS fd FROM own WINDOW w AS (ORDER BY session_id ROWS BETWEEN {len(_FFD) - 1} PRECEDING AND CURRENT ROW)", tables=OWN)(lambda s, d: M.target(s, d).withColumn("lc", ln("close")).withColumn("fd", R.frac_diff("lc", 0.4, least=1e-3, most=100)))
query("e04_regime_filter", "session_id", "p_high")(lambda s, d: R.regime_probability(M.target(s, d)))
query("c11_fracdiff_feature", "session_id", "fracdiff")(lambda s, d: R.fractional_feature(M.target(s, d)))
_REFIT = "least(greatest(CAST(ceil((i - 755) / 252.0) AS BIGINT) - 1, 0), CAST(floor((m - 756) / 252.0) AS BIGINT))"
query("c13_walk_forward_fit", "session_id", "z", sql="SELECT o.session_id, (o.close - f.mean) / f.sd AS z FROM idx o JOIN (SELECT r.k, avg(p.close) AS mean, stddev_samp(p.close) AS sd FROM (SELECT DISTINCT k FROM idx) r JOIN idx p ON p.i <= 755 + 252 * r.k GROUP BY r.k) f ON f.k = o.k", tables=f"{OWN}, idx AS (SELECT *, {_REFIT} AS k FROM (SELECT session_id, close, n - 1 AS i, count(*) OVER () AS m FROM own))")(
    lambda s, d: R.walk_forward_scan(M.target(s, d).select("ticker", "session_id", "close"), ("ticker",), 252, 756, lambda p: (p["close"].mean(), p["close"].std()), lambda p, m: ((p["close"] - m[0]) / m[1]).to_numpy(), "z")
)
query("e05_garch", "model session_id", "var")(lambda s, d: R.garch_forecasts(market_inputs(s, d)).where("var is not null"))
query("e06_conformal", "model session_id", "lower upper")(lambda s, d: R.adaptive_conformal(forecasts(s, d)))


@query("m08_sequence_windows", "session_id n", "first last", sql=f"SELECT session_id, len(xs) AS n, xs[1] AS first, xs[-1] AS last FROM (SELECT session_id, list(coalesce(r, 0)) OVER (ORDER BY session_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS xs FROM own)", tables=OWN)
def _sequences(spark, sf):
    t = Trail()
    g = M.target(spark, sf).withColumn("x", F.coalesce(t.diff(ln("close")), F.lit(0.0))).withColumn("xs", F.collect_list("x").over(t.rows(20)))
    return g.select("session_id", F.size("xs").cast("long").alias("n"), F.element_at("xs", 1).alias("first"), F.element_at("xs", -1).alias("last"))


@query("m14_persistence", "n", "rmse mae", sql="SELECT count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM (SELECT open - lag(open) OVER (ORDER BY session_id) AS e FROM own) WHERE e IS NOT NULL", tables=OWN)
def _persistence(spark, sf):
    e = M.target(spark, sf).withColumn("e", Trail().diff(F.col("open"))).where("e is not null")
    return e.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg(F.abs("e")).alias("mae"))


@query("r09_pit", "model n", "ks_stat ks_pvalue")
def _pit(spark, sf):
    """Gaussian probability integral transforms and their distance from uniform; a group for each model."""
    from ..functions import dist

    rows = forecasts(spark, sf).where("r is not null and var is not null").select("model", "r", "pred", "var")

    def run(p):
        import pandas as pd

        u = dist.norm_cdf_array(((p["r"] - p["pred"]) / np.sqrt(p["var"])).to_numpy())
        ks, pv = dist.ks_uniform(u)
        return pd.DataFrame({"model": [p["model"].iloc[0]], "n": [len(p)], "ks_stat": [ks], "ks_pvalue": [pv]})

    return rows.groupBy("model").applyInPandas(run, "model string, n long, ks_stat double, ks_pvalue double")


