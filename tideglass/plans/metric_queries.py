"""Queries of performance, forecast evaluation, risk and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist
from ..functions.windows import Trail, ratio
from ..operators import metrics as S
from ..operators.variance import har_forecasts, har_inputs, proxy
from ..sources import market as M
from .feature_queries import GRID, guard
from .portfolio_queries import BENCH, BT, FORE, MARKET, RANGES, SHARPE, benchmarks, forecasts, grid_run, market_inputs
from .query import query


def bench_run(spark, sf):
    from ..operators import portfolio as P

    return P.backtest(benchmarks(spark, sf))


def damped(spark, sf):
    """Benchmark returns at a ten-thousandth of the size: trade prices are so noisy that compounding them leaves a double's digits."""
    return bench_run(spark, sf).withColumn("net", F.col("net") / 10000)


DAMPED = f"{BENCH}, small AS (SELECT * REPLACE (net / 10000 AS net) FROM bt)"
_W = "OVER (PARTITION BY strategy ORDER BY session_id)"
DRAWN = f"""{DAMPED},
eq AS (SELECT *, exp(sum(ln(1 + net)) {_W}) AS equity FROM small),
dd AS (SELECT *, equity / max(equity) {_W} - 1 AS drawdown FROM eq),
isl AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) {_W} AS island FROM dd),
runs AS (SELECT strategy, max(n) AS run FROM (SELECT strategy, island, count(*) FILTER (drawdown < 0) AS n FROM isl GROUP BY strategy, island) GROUP BY strategy)"""
query("w18_drawdown", "strategy session_id", "equity drawdown", sql="SELECT strategy, session_id, equity, drawdown FROM dd", tables=DRAWN)(lambda s, d: S.drawdowns(damped(s, d)))
query("w18b_drawdown_run", "strategy run", sql="SELECT strategy, run FROM runs", tables=DRAWN)(lambda s, d: S.longest_run(S.drawdowns(damped(s, d)), F.col("drawdown") < 0, ("strategy",)))
query("w19_rolling_sharpe", "strategy session_id", "rolling_sharpe", sql="SELECT strategy, session_id, CASE WHEN c >= 252 THEN m / nullif(s, 0) * sqrt(252) END AS rolling_sharpe FROM (SELECT *, count(net) OVER w AS c, avg(net) OVER w AS m, stddev_samp(net) OVER w AS s FROM bt WINDOW w AS (PARTITION BY strategy ORDER BY session_id ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))", tables=BENCH)(
    lambda s, d: (lambda t: bench_run(s, d).withColumn("rolling_sharpe", ratio(t.mean("net", 252), t.std("net", 252)) * (252**0.5)))(Trail("strategy"))
)
query("r01_sharpe", "strategy", "sharpe", sql=f"SELECT strategy, {SHARPE} AS sharpe FROM bt GROUP BY strategy", tables=BT)(lambda s, d: grid_run(s, d).groupBy("strategy").agg(S.sharpe().alias("sharpe")))
_PERF = "total_return cagr ann_vol sharpe sortino calmar max_drawdown hit_rate profit_factor skew kurtosis tail_ratio exposure avg_gross turnover_ann"
query(
    "r02_performance", "strategy n max_dd_duration", _PERF,
    sql=f"""SELECT p.strategy, p.n, runs.run AS max_dd_duration, total - 1 AS total_return, power(total, 252.0 / p.n) - 1 AS cagr, ann_vol, sharpe, sortino, (power(total, 252.0 / p.n) - 1) / abs(mdd) AS calmar, mdd AS max_drawdown,
  hit_rate, gain / loss AS profit_factor, skew, kurt + 3 AS kurtosis, abs(q95 / q05) AS tail_ratio, exposure, avg_gross, turn / (p.n / 252.0) AS turnover_ann FROM
  (SELECT strategy, count(*) AS n, exp(sum(ln(1 + net))) AS total, stddev_samp(net) * sqrt(252) AS ann_vol, {SHARPE} AS sharpe, avg(net) / sqrt(sum(CASE WHEN net < 0 THEN net * net END) / count(*)) * sqrt(252) AS sortino, min(drawdown) AS mdd,
   count(*) FILTER (net > 0) * 1.0 / greatest(count(*) FILTER (net <> 0), 1) AS hit_rate, sum(net) FILTER (net > 0) AS gain, -sum(net) FILTER (net < 0) AS loss, skewness(net) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS skew, kurtosis_pop(net) AS kurt,
   quantile_cont(net, 0.95) AS q95, quantile_cont(net, 0.05) AS q05, avg(CASE WHEN abs(position) > 1e-12 THEN 1.0 ELSE 0.0 END) AS exposure, avg(abs(position)) AS avg_gross, sum(turnover) AS turn FROM dd GROUP BY strategy) p JOIN runs USING (strategy)""",
    tables=DRAWN,
)(lambda s, d: S.performance(damped(s, d)))


def dated(spark, sf):
    days = M.grid(spark, sf).select("session_id", "date").distinct()
    return damped(spark, sf).join(days, "session_id")


query("r03_yearly", "strategy year", "ret", sql="SELECT strategy, CAST(year(date) AS INTEGER) AS year, exp(sum(ln(1 + net))) - 1 AS ret FROM small JOIN sessions USING (session_id) GROUP BY 1, 2", tables=DAMPED)(lambda s, d: dated(s, d).groupBy("strategy", F.year("date").alias("year")).agg((F.product(1 + F.col("net")) - 1).alias("ret")))
query("r03b_monthly", "strategy month", "ret", sql="SELECT strategy, CAST(date_trunc('month', date) AS DATE) AS month, exp(sum(ln(1 + net))) - 1 AS ret FROM small JOIN sessions USING (session_id) GROUP BY 1, 2", tables=DAMPED)(lambda s, d: dated(s, d).groupBy("strategy", F.trunc("date", "MM").alias("month")).agg((F.product(1 + F.col("net")) - 1).alias("ret")))


def nw_sql(source: str, x: str, by: str, most: int = 12) -> str:
    terms = " + ".join(f"CASE WHEN {k} <= L THEN 2 * (1 - {k} / (L + 1.0)) * coalesce(g{k}, 0) / n ELSE 0 END" for k in range(1, most + 1))
    lags = ", ".join(f"e * lag(e, {k}) OVER (PARTITION BY {by} ORDER BY session_id) AS p{k}" for k in range(1, most + 1))
    sums = ", ".join(f"sum(p{k}) AS g{k}" for k in range(1, most + 1))
    return f"SELECT {by}, n, mean, sqrt(greatest(g0 / n + {terms}, 0) / n) AS se FROM (SELECT {by}, count(*) AS n, any_value(m) AS mean, sum(e * e) AS g0, {sums}, floor(4 * power(count(*) / 100.0, 2.0 / 9.0)) AS L FROM (SELECT *, {lags} FROM (SELECT *, {x} - avg({x}) OVER (PARTITION BY {by}) AS e, avg({x}) OVER (PARTITION BY {by}) AS m FROM {source} WHERE {x} IS NOT NULL)) GROUP BY {by})"


query("r04_newey_west", "strategy n", "mean se", sql=nw_sql("bt", "net", "strategy"), tables=BENCH)(lambda s, d: S.newey_west(bench_run(s, d), "net", ("strategy",)))
query("r05_r2_oos", "model", "r2", sql="SELECT model, 1 - sum((r - pred) * (r - pred)) / sum(r * r) AS r2 FROM fore WHERE r IS NOT NULL GROUP BY model", tables=FORE)(lambda s, d: forecasts(s, d).where("r is not null").groupBy("model").agg(S.r2_oos().alias("r2")))
query("r06_diebold_mariano", "model n", "stat mean_diff", sql="SELECT model, count(d) AS n, avg(d) / nullif(stddev_pop(d) / sqrt(count(d)), 0) * sqrt((count(d) - 1.0) / count(d)) AS stat, avg(d) AS mean_diff FROM (SELECT *, (r - pred) * (r - pred) - r * r AS d FROM fore WHERE r IS NOT NULL) GROUP BY model", tables=FORE)(
    lambda s, d: (lambda st, me: forecasts(s, d).where("r is not null").withColumn("d", (F.col("r") - F.col("pred")) ** 2 - F.col("r") ** 2).groupBy("model").agg(F.count("d").alias("n"), st.alias("stat"), me.alias("mean_diff")))(*S.diebold_mariano())
)
RANKED = f"""{FORE},
rk AS (SELECT model, session_id, rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model ORDER BY r) + (count(*) OVER (PARTITION BY model, r) - 1) / 2.0 AS rb FROM fore WHERE r IS NOT NULL AND pred IS NOT NULL),
zz AS (SELECT *, CASE WHEN max(ra) OVER w > min(ra) OVER w AND max(rb) OVER w > min(rb) OVER w THEN (ra - avg(ra) OVER w) / stddev_pop(ra) OVER w * (rb - avg(rb) OVER w) / stddev_pop(rb) OVER w END AS prod FROM rk WINDOW w AS (PARTITION BY model))"""
query("r07_information_coefficient", "model n", "ic t", sql=f"SELECT model, n, mean AS ic, mean / nullif(se, 0) AS t FROM ({nw_sql('zz', 'prod', 'model')})", tables=RANKED)(lambda s, d: S.information_coefficient(forecasts(s, d)))
query(
    "r08_pesaran_timmermann", "model n", "hit_rate stat",
    sql="SELECT model, n, hit AS hit_rate, CASE WHEN ps * (1 - ps) / n - vs > 1e-15 THEN (hit - ps) / sqrt(ps * (1 - ps) / n - vs) END AS stat FROM (SELECT *, py * px + (1 - py) * (1 - px) AS ps, power(2 * py - 1, 2) * px * (1 - px) / n + power(2 * px - 1, 2) * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n) AS vs FROM (SELECT model, count(*) AS n, avg(CASE WHEN (pred > 0) = (r > 0) THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS py, avg(CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END) AS px FROM fore WHERE r IS NOT NULL GROUP BY model))",
    tables=FORE,
)(lambda s, d: S.pesaran_timmermann(forecasts(s, d)))
query("r10_interval_coverage", "model", "coverage", sql="SELECT model, avg(CASE WHEN r BETWEEN pred - 1.645 * sqrt(var) AND pred + 1.645 * sqrt(var) THEN 1.0 ELSE 0.0 END) AS coverage FROM fore WHERE r IS NOT NULL AND var IS NOT NULL GROUP BY model", tables=FORE)(
    lambda s, d: forecasts(s, d).where("r is not null and var is not null").groupBy("model").agg(F.avg(F.col("r").between(F.col("pred") - 1.645 * F.sqrt("var"), F.col("pred") + 1.645 * F.sqrt("var")).cast("double")).alias("coverage"))
)


@query("r12_ic_decay", "model horizon", "ic", sql="SELECT model, horizon, corr(a, b) AS ic FROM (SELECT model, horizon, rank() OVER (PARTITION BY model, horizon ORDER BY pred) + (count(*) OVER (PARTITION BY model, horizon, pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model, horizon ORDER BY y) + (count(*) OVER (PARTITION BY model, horizon, y) - 1) / 2.0 AS b FROM (SELECT f.model, f.pred, h.horizon, h.y FROM fore f JOIN hz h USING (session_id) WHERE y IS NOT NULL AND model <> 'zero')) GROUP BY model, horizon", tables=f"{FORE}, hz AS (SELECT session_id, unnest([1, 5, 21]) AS horizon, unnest([ln(lead(open, 2) OVER (ORDER BY session_id)) - ln(lead(open) OVER (ORDER BY session_id)), ln(lead(open, 6) OVER (ORDER BY session_id)) - ln(lead(open) OVER (ORDER BY session_id)), ln(lead(open, 22) OVER (ORDER BY session_id)) - ln(lead(open) OVER (ORDER BY session_id))]) AS y FROM mk)")
def _decay(spark, sf):
    from ..operators.labels import forward_returns

    h = forward_returns(M.target(spark, sf)).select("session_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, (1, 5, 21))), F.array(*[f"fwd_ret_{k}" for k in (1, 5, 21)]))).alias("horizon", "y"))
    rows = forecasts(spark, sf).where("model <> 'zero'").select("model", "session_id", "pred").join(h, "session_id")
    return S.information_coefficient(rows, ("model", "horizon"), y="y")


def vol_scores(spark, sf):
    """Rolling variances as forecasts of the next session's proxy."""
    t = Trail()
    g = proxy(M.target(spark, sf)).withColumns({"next": F.lead("rv").over(t.window), "v21": t.mean("rv", 21), "v63": t.mean("rv", 63)})
    return g.select("session_id", F.col("next").alias("rv"), F.explode(F.map_from_arrays(F.array(F.lit("v21"), F.lit("v63")), F.array("v21", "v63"))).alias("model", "h")).where("rv > 0 and h > 0")


RV = f"{RANGES}, rv0 AS (SELECT ticker, session_id, yo * yo + greatest(gk, 0) AS rv FROM ranges WHERE ticker = 'ALL'), rv1 AS (SELECT session_id, lead(rv) OVER (ORDER BY session_id) AS next, {guard('avg({})', 'rv', 21)} AS v21, {guard('avg({})', 'rv', 63)} AS v63 FROM (SELECT ticker, session_id, CASE WHEN session_id > 0 THEN rv END AS rv FROM rv0)), vs AS (SELECT * FROM (SELECT session_id, next AS rv, 'v21' AS model, v21 AS h FROM rv1 UNION ALL SELECT session_id, next, 'v63', v63 FROM rv1) WHERE rv > 0 AND h > 0)"
query("r13_variance_scores", "model n", "qlike mse beta alpha r2", sql="SELECT model, count(*) AS n, avg(rv / h - ln(rv / h) - 1) AS qlike, avg((rv - h) * (rv - h)) AS mse, regr_slope(rv, h) AS beta, regr_intercept(rv, h) AS alpha, regr_r2(rv, h) AS r2 FROM vs GROUP BY model", tables=RV)(
    lambda s, d: vol_scores(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("rv") / F.col("h") - F.ln(F.col("rv") / F.col("h")) - 1).alias("qlike"), F.avg((F.col("rv") - F.col("h")) ** 2).alias("mse"), F.regr_slope("rv", "h").alias("beta"), F.regr_intercept("rv", "h").alias("alpha"), F.regr_r2("rv", "h").alias("r2"))
)


@query("r13b_mincer_zarnowitz", "model n", "alpha_t beta_t wald_p")
def _mincer(spark, sf):
    rows = vol_scores(spark, sf)
    out = []
    for name in ("v21", "v63"):
        fit = S.ols(rows.where(F.col("model") == name), ["h"], "rv")
        out.append((name, fit["n"], fit["alpha_t"], fit["betas"]["h"]["t"], S.wald_unit(fit)))
    return spark.createDataFrame(out, "model string, n long, alpha_t double, beta_t double, wald_p double")


def attribution_rows(spark, sf):
    """Trend rule's net return against the sector fund's holding return."""
    bt = bench_run(spark, sf).where("strategy = 'trend_200'").select("session_id", "net")
    fund = market_inputs(spark, sf, M.SECTOR).select("session_id", F.expm1("r").alias("x"))
    return bt.join(fund, "session_id").where("net is not null and x is not null")


query("r14_attribution", "n", "alpha_ann beta r2", sql="SELECT count(*) AS n, regr_intercept(net, x) * 252 AS alpha_ann, regr_slope(net, x) AS beta, regr_r2(net, x) AS r2 FROM (SELECT b.net, exp(f.r) - 1 AS x FROM bt b JOIN m2 f ON f.session_id = b.session_id AND f.ticker = 'A' WHERE b.strategy = 'trend_200' AND f.r IS NOT NULL)", tables=BENCH)(
    lambda s, d: (lambda fit: s.createDataFrame([(fit["n"], fit["alpha_ann"], fit["betas"]["x"]["beta"], fit["r2"])], "n long, alpha_ann double, beta double, r2 double"))(S.ols(attribution_rows(s, d), ["x"], "net"))
)
query("j11_next_session_map", "session_id", "factor", sql="SELECT session_id, lead(r) OVER (ORDER BY session_id) AS factor FROM ranges WHERE ticker = 'A'", tables=RANGES)(lambda s, d: (lambda t: M.grid(s, d).where("ticker = 'A'").withColumn("f", t.diff(F.ln("close"))).withColumn("factor", F.lead("f").over(t.window)))(Trail()))

Z95, Z99 = dist.norm_ppf(0.05), dist.norm_ppf(0.01)
_VW = 250
RISK = f"""{MARKET}, rr AS (SELECT ticker, session_id, exp(r) - 1 AS x FROM mk WHERE r IS NOT NULL),
rw AS (SELECT *, count(x) OVER w AS c, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s, quantile_cont(x, 0.05) OVER w AS q, skewness(x) OVER w AS g1, kurtosis(x) OVER w AS g2, list(x) OVER w AS xs FROM rr WINDOW w AS (ORDER BY session_id ROWS BETWEEN {_VW - 1} PRECEDING AND CURRENT ROW))"""


def risk_rows(spark, sf):
    return market_inputs(spark, sf).where("r is not null").withColumn("x", F.expm1("r")).select("ticker", "session_id", "x", "var")


def _risk(make):
    return lambda s, d: risk_rows(s, d).withColumn("v", make(Trail()))


query("w26_var_historical", "session_id", "v", sql=f"SELECT session_id, CASE WHEN c >= {_VW} THEN -q END AS v FROM rw", tables=RISK)(_risk(lambda t: S.var_historical(t, "x", 0.95, _VW)))
query("w27_var_parametric", "session_id", "v", sql=f"SELECT session_id, CASE WHEN c >= {_VW} THEN -(m + {Z95!r} * s) END AS v FROM rw", tables=RISK)(_risk(lambda t: S.var_parametric(t, "x", 0.95, _VW)))
_CF = f"({Z95!r} + {Z95**2 - 1!r} * g1 / 6 + {Z95**3 - 3 * Z95!r} * g2 / 24 - {2 * Z95**3 - 5 * Z95!r} * g1 * g1 / 36)"
query("w28_var_cornish_fisher", "session_id", "v", sql=f"SELECT session_id, CASE WHEN c >= {_VW} THEN -(m + {_CF} * s) END AS v FROM rw", tables=RISK)(_risk(lambda t: S.var_cornish_fisher(t, "x", 0.95, _VW)))
query("w29_expected_shortfall", "session_id", "es", sql=f"SELECT session_id, CASE WHEN c >= {_VW} THEN -list_avg(list_filter(xs, lambda z: z <= q)) END AS es FROM rw", tables=RISK)(lambda s, d: S.expected_shortfall(risk_rows(s, d), Trail(), "x", 0.95, _VW))
query("w30_sizing_scale", "session_id", "v", sql="SELECT session_id, CASE WHEN count(x) OVER w >= 63 THEN stddev_samp(x) OVER w END AS v FROM rr WINDOW w AS (ORDER BY session_id ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", tables=RISK)(_risk(lambda t: t.std("x", 252, 63)))
query("w31_har_inputs", "session_id", "d w m", sql=f"SELECT session_id, d, {guard('avg({})', 'd', 5)} AS w, {guard('avg({})', 'd', 22)} AS m FROM (SELECT ticker, session_id, CASE WHEN session_id > 0 THEN ln(greatest(rv, 1e-8)) END AS d FROM rv0)", tables=RV)(
    lambda s, d: har_inputs(M.target(s, d))
)
_COV = ", ".join(f"covar_samp({a}k, {b}k) OVER p AS {a}{b}" for a, b in ("dd", "dw", "dm", "dy", "ww", "wm", "wy", "mm", "my", "yy"))
_HAR = f"""{RV}, h0 AS (SELECT session_id, d, {guard('avg({})', 'd', 5)} AS w, {guard('avg({})', 'd', 22)} AS m, lead(d) OVER (ORDER BY session_id) AS y FROM (SELECT ticker, session_id, CASE WHEN session_id > 0 THEN ln(greatest(rv, 1e-8)) END AS d FROM rv0)),
h1 AS (SELECT *, row_number() OVER (ORDER BY session_id) - 1 AS i, CASE WHEN y IS NOT NULL THEN d END AS dk, CASE WHEN y IS NOT NULL THEN w END AS wk, CASE WHEN y IS NOT NULL THEN m END AS mk, y AS yk FROM h0 WHERE d IS NOT NULL AND w IS NOT NULL AND m IS NOT NULL),
h2 AS (SELECT i, count(yk) OVER p AS n, avg(dk) OVER p AS ad, avg(wk) OVER p AS aw, avg(mk) OVER p AS am, avg(yk) OVER p AS ay, {_COV} FROM h1 WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h3 AS (SELECT *, dd * (ww * mm - wm * wm) - dw * (dw * mm - wm * dm) + dm * (dw * wm - ww * dm) AS det FROM h2 WHERE i >= 755 AND (i - 755) % 21 = 0),
h4 AS (SELECT *, (dy * (ww * mm - wm * wm) - dw * (wy * mm - wm * my) + dm * (wy * wm - ww * my)) / det AS bd, (dd * (wy * mm - wm * my) - dy * (dw * mm - wm * dm) + dm * (dw * my - wy * dm)) / det AS bw, (dd * (ww * my - wy * wm) - dw * (dw * my - wy * dm) + dy * (dw * wm - ww * dm)) / det AS bm FROM h3)"""
query("m18b_har_variance", "ticker session_id", "var", sql="SELECT 'ALL' AS ticker, h1.session_id, exp(ay + bd * (d - ad) + bw * (w - aw) + bm * (m - am) + (n - 1) * (yy - bd * dy - bw * wy - bm * my) / (n - 4) / 2) AS var FROM h1 JOIN h4 ON h4.i = h1.i - (h1.i - 755) % 21 WHERE h1.i >= 755", tables=_HAR)(lambda s, d: har_forecasts(M.target(s, d)))


def xlogy_sql(x: str, y: str) -> str:
    return f"CASE WHEN ({x}) = 0 THEN 0 ELSE ({x}) * ln(CASE WHEN ({y}) > 0 THEN ({y}) END) END"


def lr_sql(level: float, var: str, source: str = "rw", by: str = "ticker") -> str:
    p = 1 - level
    x = xlogy_sql
    uc = f"-2 * ({x('n - k', repr(1 - p))} + {x('k', repr(p))} - ({x('n - k', '1 - k / n')}) - ({x('k', 'k / n')}))"
    p01, p11, p1 = "n01 / greatest(n00 + n01, 1)", "n11 / greatest(n10 + n11, 1)", "(n01 + n11) / greatest(n00 + n01 + n10 + n11, 1)"
    null = f"{x('n00 + n10', f'1 - {p1}')} + {x('n01 + n11', p1)}"
    alt = f"{x('n00', f'1 - {p01}')} + {x('n01', p01)} + {x('n10', f'1 - {p11}')} + {x('n11', p11)}"
    over = f"OVER (PARTITION BY {by} ORDER BY session_id)"
    counts = ", ".join(f"CAST(count(*) FILTER (b = {a} AND h = {c}) AS DOUBLE) AS n{a}{c}" for a in (0, 1) for c in (0, 1))
    hits = f"SELECT *, lag(h) {over} AS b FROM (SELECT *, CASE WHEN -x > v THEN 1 ELSE 0 END AS h FROM (SELECT {by}, session_id, x, lag({var}, 2) {over} AS v FROM {source}) WHERE v > 0)"
    return f"SELECT {by}, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS exceptions, k / n AS rate, {uc} AS lr_uc, -2 * (({null}) - ({alt})) AS lr_ind FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(h) AS DOUBLE) AS k, {counts} FROM ({hits}) GROUP BY {by})"


query("r15_var_backtest", "ticker n exceptions", "rate lr_uc lr_ind", sql=lr_sql(0.95, f"CASE WHEN c >= {_VW} THEN -q END"), tables=RISK)(lambda s, d: S.var_backtest(_risk(lambda t: S.var_historical(t, "x", 0.95, _VW))(s, d), ("ticker",), "x", "v", 0.95))
query("r15b_var_backtest_normal", "ticker n exceptions", "rate lr_uc lr_ind", sql=lr_sql(0.99, f"CASE WHEN c >= {_VW} THEN -(m + {Z99!r} * s) END"), tables=RISK)(lambda s, d: S.var_backtest(_risk(lambda t: S.var_parametric(t, "x", 0.99, _VW))(s, d), ("ticker",), "x", "v", 0.99))

_STRESS = [("early", "1996-01-01", "1996-03-31"), ("autumn", "1998-08-01", "1998-10-31"), ("late", "2001-09-01", "2001-10-15"), ("never", "1980-01-01", "1980-02-01")]


@query(
    "r16_stress_windows", "name strategy covered n", "total_return max_drawdown",
    sql="SELECT v.name, w.strategy, w.strategy IS NOT NULL AS covered, coalesce(w.n, 0) AS n, total_return, max_drawdown FROM windows v LEFT JOIN (SELECT name, strategy, count(*) AS n, arg_max(eq, session_id) - 1 AS total_return, min(eq / top - 1) AS max_drawdown FROM (SELECT *, max(eq) OVER (PARTITION BY name, strategy ORDER BY session_id) AS top FROM (SELECT v.name, s.strategy, s.session_id, exp(sum(ln(1 + net)) OVER (PARTITION BY v.name, s.strategy ORDER BY s.session_id)) AS eq FROM small s JOIN sessions d ON d.session_id = s.session_id + 1 JOIN windows v ON d.date BETWEEN v.a AND v.b)) GROUP BY name, strategy) w USING (name)",
    tables=f"{DAMPED}, windows(name, a, b) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _STRESS)})",
)
def _stress(spark, sf):
    return stress(spark, damped(spark, sf), M.grid(spark, sf).select("session_id", "date").distinct(), _STRESS)


def stress(spark, rows, days, windows):
    """Total return and drawdown of every strategy in named windows, dated by the session the holding begins; uncovered ones are kept."""
    named = spark.createDataFrame(windows, "name string, a string, b string").select("name", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    held = rows.join(days.select((F.col("session_id") - 1).alias("session_id"), "date"), "session_id")
    inside = held.join(F.broadcast(named), F.col("date").between(F.col("a"), F.col("b")))
    d = S.drawdowns(inside, ("name", "strategy"))
    out = d.groupBy("name", "strategy").agg(F.count(F.lit(1)).alias("n"), (F.max_by("equity", "session_id") - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"))
    return named.join(out, "name", "left").select("name", "strategy", F.col("strategy").isNotNull().alias("covered"), F.coalesce("n", F.lit(0)).alias("n"), "total_return", "max_drawdown")


query("r16b_regime_split", "strategy regime n", "sharpe total", sql=f"SELECT strategy, regime, count(*) AS n, {SHARPE} AS sharpe, exp(sum(ln(1 + net))) - 1 AS total FROM (SELECT s.*, CASE WHEN m.p_high > 0.5 THEN 'high_vol' ELSE 'low_vol' END AS regime FROM small s JOIN mk m USING (session_id)) GROUP BY strategy, regime HAVING count(*) > 20", tables=DAMPED)(
    lambda s, d: damped(s, d).join(market_inputs(s, d).select("session_id", "p_high"), "session_id").withColumn("regime", F.when(F.col("p_high") > 0.5, "high_vol").otherwise("low_vol")).groupBy("strategy", "regime").agg(F.count(F.lit(1)).alias("n"), S.sharpe().alias("sharpe"), (F.product(1 + F.col("net")) - 1).alias("total")).where("n > 20")
)
query("j12_holding_dates", "strategy session_id held_from", sql="SELECT b.strategy, b.session_id, s.date AS held_from FROM bt b JOIN sessions s ON s.session_id = b.session_id + 1", tables=BENCH)(
    lambda s, d: bench_run(s, d).join(M.grid(s, d).select((F.col("session_id") - 1).alias("session_id"), F.col("date").alias("held_from")).distinct(), "session_id")
)
query("j16_date_windows", "name n", sql="SELECT v.name, count(s.session_id) AS n FROM windows v LEFT JOIN sessions s ON s.date BETWEEN v.a AND v.b GROUP BY v.name", tables=f"{GRID}, windows(name, a, b) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _STRESS)})")(
    lambda s, d: s.createDataFrame(_STRESS, "name string, a string, b string").join(M.grid(s, d).select("session_id", "date").distinct(), F.col("date").between(F.to_date("a"), F.to_date("b")), "left").groupBy("name").agg(F.count("session_id").alias("n"))
)
Z = dist.norm_ppf(0.95)
MOM = "SELECT strategy, count(net) AS n, avg(net) / stddev_samp(net) AS sr, skewness(net) * (count(net) - 2) / sqrt(count(net) * (count(net) - 1.0)) AS skew, kurtosis_pop(net) + 3 AS kurt FROM bt GROUP BY strategy"
query("r18_min_track_record", "strategy n", "sr mintrl", sql=f"SELECT strategy, n, sr, CASE WHEN sr > 0 THEN 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * power({Z!r} / sr, 2) END AS mintrl FROM ({MOM})", tables=BENCH, digits=4)(
    lambda s, d: S.moments(bench_run(s, d)).withColumn("mintrl", F.when(F.col("sr") > 0, 1 + (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2) * F.pow(Z / F.col("sr"), F.lit(2.0))))
)


@query("r18b_deflated_sharpe", "strategy", "psr dsr")
def _deflated(spark, sf):
    rows = bench_run(spark, sf).select("strategy", "net")
    out = [(r.strategy, S.psr(r.sr, r.n, r.skew, r.kurt), S.deflated_sharpe(rows, r.strategy)["dsr"]) for r in S.moments(rows).collect() if r.sr is not None]
    return spark.createDataFrame(out, "strategy string, psr double, dsr double")


@query(
    "r19_pbo", "combo", "logit is_best oos_best",
    sql="SELECT combo, ln(w / (1 - w)) AS logit, is_sr AS is_best, oos_sr AS oos_best FROM (SELECT *, rk / (m + 1.0) AS w, row_number() OVER (PARTITION BY combo ORDER BY coalesce(is_sr, -1e300) DESC, strategy DESC) AS best FROM (SELECT *, rank() OVER (PARTITION BY combo ORDER BY oos_sr) + (count(*) OVER (PARTITION BY combo, oos_sr) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY combo) AS m FROM (SELECT combo, strategy, max(sr) FILTER (inside) AS is_sr, coalesce(max(sr) FILTER (NOT inside), 0) AS oos_sr FROM (SELECT c.combo, b.strategy, (c.k >> (15 - b.block)) & 1 = 1 AS inside, avg(b.net) / nullif(stddev_samp(b.net), 0) AS sr FROM blocked b CROSS JOIN combos c GROUP BY 1, 2, 3) GROUP BY combo, strategy))) WHERE best = 1",
    tables=f"{BENCH}, com AS (SELECT session_id, ntile(16) OVER (ORDER BY session_id) - 1 AS block FROM (SELECT session_id FROM bt GROUP BY session_id HAVING count(*) = (SELECT count(DISTINCT strategy) FROM bt))), blocked AS (SELECT b.strategy, c.block, b.net FROM bt b JOIN com c USING (session_id)), combos AS (SELECT CAST(row_number() OVER (ORDER BY k DESC) - 1 AS INTEGER) AS combo, k FROM range(65536) t(k) WHERE bit_count(k) = 8)",
)
def _pbo(spark, sf):
    return S.pbo(spark, bench_run(spark, sf).select("strategy", "session_id", "net"), 16)


@query(
    "r25_concentration", "strategy", "sum_share dollar_share",
    sql="SELECT strategy, sum(net) FILTER (y IN (1999, 2000)) / nullif(sum(net), 0) AS sum_share, (exp(sum(ln(1 + net)) FILTER (y <= 2000)) - exp(sum(ln(1 + net)) FILTER (y < 1999))) / nullif(exp(sum(ln(1 + net))) - 1, 0) AS dollar_share FROM (SELECT s.*, year(d.date) AS y FROM small s JOIN sessions d USING (session_id)) GROUP BY strategy",
    tables=DAMPED,
)
def _concentration(spark, sf):
    y, net = F.year("date"), F.col("net")
    upto = lambda c: F.exp(F.sum(F.when(c, F.log1p(net))))
    return dated(spark, sf).groupBy("strategy").agg(ratio(F.sum(F.when(y.isin(1999, 2000), net)), F.sum(net)).alias("sum_share"), ratio(upto(y <= 2000) - upto(y < 1999), F.product(1 + net) - 1).alias("dollar_share"))




_SW = "(PARTITION BY strategy ORDER BY session_id ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)"


@query("r24b_risk_of_benchmarks", "strategy n exceptions", "rate lr_uc lr_ind", sql=lr_sql(0.95, f"CASE WHEN c >= {_VW} THEN -q END", "sw", "strategy"), tables=f"{BENCH}, sw AS (SELECT strategy, session_id, net AS x, count(net) OVER {_SW} AS c, quantile_cont(net, 0.05) OVER {_SW} AS q FROM bt)")
def _risk_of_benchmarks(spark, sf):
    """Value-at-risk tests of every benchmark in one plan."""
    rows = bench_run(spark, sf).withColumn("v", S.var_historical(Trail("strategy"), "net", 0.95, _VW))
    return S.var_backtest(rows, ("strategy",), "net", "v", 0.95)
