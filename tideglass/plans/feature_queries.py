"""Queries of trailing-window, cross-asset, macro and calendar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import Trail
from ..operators import features as X
from ..sources import market as M
from .query import QUERIES, query

ANN, LN2 = X.ANN, X.LN2
KEYS = "ticker session_id"
GRID = M.GRID_SQL


def _built(*specs: str):
    return lambda spark, sf: X.build(M.grid(spark, sf), list(specs))


def _context(*specs: str):
    return lambda spark, sf: X.build(X.target_frame(spark, sf), list(specs))


def guard(fn: str, x: str, w: int, need: int | None = None) -> str:
    """A guarded trailing window in SQL."""
    over = f"OVER (PARTITION BY ticker ORDER BY session_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {need or w} THEN {fn.format(x)} {over} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY ticker ORDER BY session_id)"


query("w01_log_returns", KEYS, "ret_1 ret_5 ret_21 ret_63", sql="SELECT ticker, session_id, " + ", ".join(f"ln(close) - ln({lag('close', h)}) AS ret_{h}" for h in (1, 5, 21, 63)) + " FROM grid", tables=GRID)(_built("returns"))
query("w02_overnight_intraday", KEYS, "ret_overnight ret_intraday", sql=f"SELECT ticker, session_id, ln(open) - ln({lag('close')}) AS ret_overnight, ln(close) - ln(open) AS ret_intraday FROM grid", tables=GRID)(_built("returns"))

RANGES = f"""{GRID},
ranges AS (SELECT *, ln(close) - ln({lag('close')}) AS r, ln(close) - ln(open) AS co, ln(open) - ln({lag('close')}) AS yo,
  power(ln(high) - ln(low), 2) / (4 * ln(2)) AS park, 0.5 * power(ln(high) - ln(low), 2) - (2 * ln(2) - 1) * power(ln(close) - ln(open), 2) AS gk,
  (ln(high) - ln(open)) * (ln(high) - ln(close)) + (ln(low) - ln(open)) * (ln(low) - ln(close)) AS rs FROM grid)"""


def _yz(w: int) -> str:
    k = 0.34 / (1.34 + (w + 1) / (w - 1))
    return f"sqrt(greatest({guard('var_samp({})', 'yo', w)} + {k!r} * ({guard('var_samp({})', 'co', w)}) + {1 - k!r} * ({guard('avg({})', 'rs', w)}), 0)) * sqrt(252)"


_VOLS = {
    "cc": lambda w: f"({guard('stddev_samp({})', 'r', w)}) * sqrt(252)",
    "park": lambda w: f"sqrt({guard('avg({})', 'park', w)}) * sqrt(252)",
    "gk": lambda w: f"sqrt(greatest({guard('avg({})', 'gk', w)}, 0)) * sqrt(252)",
    "rs": lambda w: f"sqrt(greatest({guard('avg({})', 'rs', w)}, 0)) * sqrt(252)",
    "yz": _yz,
}


def _realized(kind: str):
    def plan(spark, sf):
        t = Trail()
        g = M.grid(spark, sf).withColumns(X.ranges(t))
        return g.select("ticker", "session_id", *[X.realized(t, w)[f"rv_{kind}_{w}"].alias(f"rv_{kind}_{w}") for w in (21, 63)])

    return plan


for _n, (_kind, _title) in enumerate((("cc", "close_to_close"), ("park", "parkinson"), ("gk", "garman_klass"), ("rs", "rogers_satchell"), ("yz", "yang_zhang")), 3):
    query(
        f"w{_n:02d}_{_title}", KEYS, f"rv_{_kind}_21 rv_{_kind}_63",
        sql=f"SELECT ticker, session_id, CASE WHEN v21 IS NOT NULL THEN {_VOLS[_kind](21)} END AS rv_{_kind}_21, CASE WHEN v63 IS NOT NULL THEN {_VOLS[_kind](63)} END AS rv_{_kind}_63 FROM (SELECT *, {guard('avg({})', {'cc': 'r', 'park': 'park', 'gk': 'gk', 'rs': 'rs', 'yz': 'yo'}[_kind], 21)} AS v21, {guard('avg({})', {'cc': 'r', 'park': 'park', 'gk': 'gk', 'rs': 'rs', 'yz': 'yo'}[_kind], 63)} AS v63 FROM ranges) ranges",
        tables=RANGES,
    )(_realized(_kind))

VOLS = f"{RANGES}, vols AS (SELECT ticker, session_id, " + ", ".join(f"CASE WHEN ({_VOLS[k](w)}) > 0 AND ({guard('avg({})', {'cc': 'r', 'park': 'park', 'gk': 'gk', 'rs': 'rs', 'yz': 'yo'}[k], w)}) IS NOT NULL THEN ln({_VOLS[k](w)}) END AS log_rv_{k}_{w}" for k in _VOLS for w in (21, 63)) + " FROM ranges)"
_LOGS = [f"log_rv_{k}_{w}" for k in _VOLS for w in (21, 63)]
query("w08_log_vols", KEYS, " ".join(_LOGS), sql="SELECT * FROM vols", tables=VOLS)(_built("volatility"))
query("w09_vol_of_vol", KEYS, "volvol_63", sql=f"SELECT ticker, session_id, {guard('stddev_samp({})', 'd', 63)} AS volvol_63 FROM (SELECT *, log_rv_cc_21 - {lag('log_rv_cc_21')} AS d FROM vols)", tables=VOLS)(_built("volatility"))
query("w10_rv_ratio", KEYS, "rv_ratio", sql="SELECT ticker, session_id, log_rv_cc_21 - log_rv_cc_63 AS rv_ratio FROM vols", tables=VOLS)(_built("volatility"))
query("w11_momentum", KEYS, "mom_12_1 mom_6_1", sql=f"SELECT ticker, session_id, ln({lag('close', 21)}) - ln({lag('close', 252)}) AS mom_12_1, ln({lag('close', 21)}) - ln({lag('close', 126)}) AS mom_6_1 FROM grid", tables=GRID)(_built("momentum"))
query(
    "w12_reversal", KEYS, "rev_z5 rev_z1",
    sql=f"SELECT ticker, session_id, -(ln(close) - ln({lag('close', 5)})) / nullif(s * sqrt(5), 0) AS rev_z5, -(ln(close) - ln({lag('close', 1)})) / nullif(s, 0) AS rev_z1 FROM (SELECT *, {guard('stddev_samp({})', 'r', 63)} AS s FROM ranges)",
    tables=RANGES,
)(_built("momentum"))
query("w13_average_distance", KEYS, "dist_ma50 dist_ma200", sql=f"SELECT ticker, session_id, ln(close) - ln({guard('avg({})', 'close', 50)}) AS dist_ma50, ln(close) - ln({guard('avg({})', 'close', 200)}) AS dist_ma200 FROM grid", tables=GRID)(_built("momentum"))
query("w16_bollinger", KEYS, "bb_pctb_20", sql=f"SELECT ticker, session_id, (close - (m - 2 * s)) / nullif(4 * s, 0) AS bb_pctb_20 FROM (SELECT *, {guard('avg({})', 'close', 20)} AS m, {guard('stddev_samp({})', 'close', 20)} AS s FROM grid)", tables=GRID)(_built("bollinger"))
query("w20_volume_z", KEYS, "volume_z", sql=f"SELECT ticker, session_id, (lv - ({guard('avg({})', 'lv', 63)})) / nullif({guard('stddev_samp({})', 'lv', 63)}, 0) AS volume_z FROM (SELECT *, CASE WHEN volume > 0 THEN ln(volume) END AS lv FROM grid)", tables=GRID)(_built("volume"))
ILL = f"""{RANGES},
ill AS (SELECT *, abs(r) / nullif(close * volume, 0) AS i, close * volume AS dollar FROM ranges),
chained AS (SELECT ticker, session_id, ln(({guard('avg({})', 'i', 21)}) * 1e9) AS la, ln({guard('avg({})', 'dollar', 21)}) AS ld FROM ill)"""
query("w21_amihud", KEYS, "amihud_z", sql=f"SELECT ticker, session_id, (la - ({guard('avg({})', 'la', 252)})) / nullif({guard('stddev_samp({})', 'la', 252)}, 0) AS amihud_z FROM chained", tables=ILL)(_built("volume"))
query("w22_dollar_volume", KEYS, "dollar_vol_rel", sql=f"SELECT ticker, session_id, ld - ({guard('avg({})', 'ld', 252)}) AS dollar_vol_rel FROM chained", tables=ILL)(_built("volume"))


@query("w24_trend_side", "ticker session_id side", sql=f"SELECT ticker, session_id, CASE WHEN close > m THEN 1 ELSE 0 END AS side FROM (SELECT *, {guard('avg({})', 'close', 50)} AS m FROM grid)", tables=GRID)
def _trend(spark, sf):
    return M.grid(spark, sf).select("ticker", "session_id", trend_side(Trail(), 50).alias("side"))


def trend_side(t: Trail, w: int):
    return F.when(F.col("close") > t.mean("close", w), 1).otherwise(0)


@query("w25_dollar_adv", KEYS, "adv", sql=f"SELECT ticker, session_id, {lag('a')} AS adv FROM (SELECT *, {guard('avg({})', 'd', 20)} AS a FROM (SELECT *, close * volume AS d FROM grid))", tables=GRID, digits=4)
def _adv(spark, sf):
    t = Trail()
    return M.grid(spark, sf).withColumn("d", F.col("close") * F.col("volume")).withColumn("a", t.mean("d", 20)).withColumn("adv", t.lag("a"))


# cross-asset, macro and calendar columns of the target: one session of lag for what is exogenous
CONTEXT = f"""{GRID}, {M.MACRO_SQL},
own AS (SELECT *, ln(close) - ln({lag('close')}) AS r, ln(close) - ln({lag('close', 5)}) AS r5, ln(close) - ln({lag('close', 21)}) AS r21 FROM grid),
wide AS (SELECT o.ticker, o.session_id, o.date, o.r, o.r5, o.r21, a.r AS ra, n.r AS rn, a.r5 AS ra5, n.r5 AS rn5, x.r21 AS rx21
  FROM own o JOIN own a ON a.session_id = o.session_id AND a.ticker = 'A' JOIN own n ON n.session_id = o.session_id AND n.ticker = 'N' JOIN own x ON x.session_id = o.session_id AND x.ticker = 'R' WHERE o.ticker = 'ALL')"""


def _pairwise(fn: str, y: str, w: int = 63) -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY session_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(r + {y}) {over} >= {w} THEN {fn}(CASE WHEN {y} IS NOT NULL THEN r END, CASE WHEN r IS NOT NULL THEN {y} END) {over} END"


query(
    "c04_beta_corr", KEYS, "beta_sector corr_sector beta_broad corr_broad",
    sql="SELECT ticker, session_id, " + ", ".join(f"{lag(f'{a}{n}')} AS {b}_{m}" for n, m in (("a", "sector"), ("n", "broad")) for a, b in (("b", "beta"), ("c", "corr"))) + " FROM (SELECT *, " + ", ".join(f"({_pairwise('covar_samp', f'r{n}')}) / nullif({guard('var_samp({})', f'r{n}', 63)}, 0) AS b{n}, {_pairwise('corr', f'r{n}')} AS c{n}" for n in "an") + " FROM wide)",
    tables=CONTEXT,
)(_context("beta_corr"))
query(
    "c05_peers", KEYS, "rs_peers_5 rs_peers_21 peer_disp_21 peer_ret_1",
    sql=f"SELECT ticker, session_id, {lag('d5')} AS rs_peers_5, {lag('d21')} AS rs_peers_21, {lag('s21')} AS peer_disp_21, {lag('m1')} AS peer_ret_1 FROM (SELECT o.ticker, o.session_id, o.r5 - p.m5 AS d5, o.r21 - p.m21 AS d21, p.s21, p.m1 FROM own o JOIN (SELECT session_id, avg(r) AS m1, avg(r5) AS m5, avg(r21) AS m21, stddev_samp(r21) AS s21 FROM own WHERE ticker <> 'ALL' GROUP BY session_id) p USING (session_id) WHERE o.ticker = 'ALL')",
    tables=CONTEXT,
)(_context("peers"))
query("c06_fund_returns", KEYS, "sector_ret_1 sector_ret_5 broad_ret_5 index_ret_21", sql=f"SELECT ticker, session_id, {lag('ra')} AS sector_ret_1, {lag('ra5')} AS sector_ret_5, {lag('rn5')} AS broad_ret_5, {lag('rx21')} AS index_ret_21 FROM wide", tables=CONTEXT)(_context("fund_returns"))
_MACRO = {
    "vix_log": "ln(vix)", "vix_chg_5": f"ln(vix) - ln({lag('vix', 5)})", "vix_term": "ln(vix) - ln(vix3m)", "slope_10_2": "dgs10 - dgs2",
    "dgs10_chg_21": f"dgs10 - {lag('dgs10', 21)}", "dgs2_chg_21": f"dgs2 - {lag('dgs2', 21)}", "tnx_chg_5": f"dgs10 - {lag('dgs10', 5)}",
}
query(
    "c07_macro", KEYS, " ".join(_MACRO),
    sql="SELECT ticker, session_id, " + ", ".join(f"{lag(n)} AS {n}" for n in _MACRO) + " FROM (SELECT ticker, session_id, " + ", ".join(f"{x} AS {n}" for n, x in _MACRO.items()) + " FROM (SELECT g.ticker, g.session_id, CASE WHEN vix > 0 THEN vix END AS vix, vix3m, dgs10, dgs2 FROM grid g LEFT JOIN macro m ON m.date = g.date WHERE g.ticker = 'ALL'))",
    tables=CONTEXT,
)(_context("macro"))

EVENTS = f"""{GRID}, {M.EVENTS_SQL},
event_sessions AS (SELECT DISTINCT s.session_id FROM (SELECT CASE WHEN timing = 'bmo' THEN date - 1 ELSE date END AS at FROM event_days) e ASOF JOIN sessions s ON s.date <= e.at),
flagged AS (SELECT s.session_id, e.session_id IS NOT NULL AS is_event FROM sessions s LEFT JOIN event_sessions e USING (session_id))"""
query(
    "c01_earnings", "ticker session_id", "days_to_earn days_since_earn earn_next",
    sql="SELECT 'ALL' AS ticker, session_id, n AS days_to_earn, p AS days_since_earn, CASE WHEN n = 0 THEN 1 ELSE 0 END AS earn_next FROM (SELECT session_id, least(coalesce(min(CASE WHEN is_event THEN session_id END) OVER (ORDER BY session_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - session_id, 20), 20) AS n, least(coalesce(session_id - max(CASE WHEN is_event THEN session_id END) OVER (ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 63), 63) AS p FROM flagged)",
    tables=EVENTS,
)(_context("earnings"))

PUBLISHED = f"""{GRID},
published AS (SELECT date, session_id FROM sessions UNION ALL SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS date, s + k AS session_id FROM (SELECT max(date) AS d, max(session_id) AS s FROM sessions), range(1, 46) t(k)),
friday AS (SELECT *, date_trunc('month', date) AS month, CAST(date_trunc('month', date) AS DATE) + CAST((12 - dayofweek(date_trunc('month', date))) % 7 AS INTEGER) + 14 AS third FROM published),
month_ends AS (SELECT month, max(session_id) AS e, max(CASE WHEN date <= third THEN date END) AS expiry FROM friday GROUP BY month),
weeks AS (SELECT DISTINCT expiry + CAST((12 - dayofweek(expiry)) % 7 AS INTEGER) AS week FROM month_ends)"""
query("c02_month_end", "ticker session_id", "sessions_to_month_end", sql="SELECT 'ALL' AS ticker, s.session_id, least(m.e - s.session_id, 5) AS sessions_to_month_end FROM sessions s JOIN month_ends m ON m.month = date_trunc('month', s.date)", tables=PUBLISHED)(_context("calendar"))
query("c03_expiry_week", "ticker session_id", "opex_week", sql="SELECT 'ALL' AS ticker, s.session_id, CASE WHEN w.week IS NULL THEN 0 ELSE 1 END AS opex_week FROM sessions s LEFT JOIN weeks w ON w.week = s.date + CAST((12 - dayofweek(s.date)) % 7 AS INTEGER)", tables=PUBLISHED)(_context("calendar"))


@query("c08_exogenous_lag", KEYS, "lagged", sql=f"SELECT ticker, session_id, {lag('x', 2)} AS lagged FROM (SELECT *, ln(close) - ln({lag('close', 5)}) AS x FROM grid WHERE ticker = 'A')", tables=GRID)
def _exogenous(spark, sf):
    g = M.grid(spark, sf).where("ticker = 'A'").withColumn("sector_close", F.col("close")).withColumn("broad_close", F.col("close")).withColumn("index_close", F.col("close"))
    return X.build(g, ["fund_returns"], X.Params(exogenous_lag=2)).withColumnRenamed("sector_ret_5", "lagged")


#: The queries that say each group of the frame's columns in SQL.
_PARTS = ("w01_log_returns", "w02_overnight_intraday", "w08_log_vols", "w09_vol_of_vol", "w10_rv_ratio", "w11_momentum", "w12_reversal", "w13_average_distance", "w16_bollinger", "w20_volume_z", "w21_amihud", "w22_dollar_volume", "c01_earnings", "c02_month_end", "c03_expiry_week", "c04_beta_corr", "c05_peers", "c06_fund_returns", "c07_macro")
_FRAME = [c for n in _PARTS for c in QUERIES[n].values]


@query("c09_feature_frame", KEYS, " ".join(_FRAME), sql=f"SELECT * FROM ({QUERIES[_PARTS[0]].sql()}) " + " ".join(f"LEFT JOIN ({QUERIES[n].sql()}) USING (ticker, session_id)" for n in _PARTS[1:]) + " WHERE ticker = 'ALL'")
def _frame(spark, sf):
    """Every registered column of the target in one plan."""
    f = X.build(X.target_frame(spark, sf))
    if missing := set(f.columns) ^ {"ticker", "session_id", "date", *_FRAME}:
        raise ValueError(f"columns that the frame or its queries lack: {sorted(missing)}")
    return f


@query("k10_column_stats", "feature", "mean std min max", sql="SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM (SELECT unnest(['ret_1', 'ret_5', 'ret_21']) AS feature, unnest([a, b, c]) AS v FROM (SELECT " + ", ".join(f"ln(close) - ln({lag('close', h)}) AS {n}" for h, n in ((1, "a"), (5, "b"), (21, "c"))) + " FROM (SELECT * FROM grid WHERE ticker = 'ALL')) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) GROUP BY feature", tables=GRID)
def _column_stats(spark, sf):
    f = X.build(M.target(spark, sf), ["returns"]).select("ret_1", "ret_5", "ret_21").na.drop()
    return f.unpivot([], ["ret_1", "ret_5", "ret_21"], "feature", "v").groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))

