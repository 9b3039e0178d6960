"""Queries of labels, sample weights and splitters."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.windows import Trail, ln
from ..operators import labels as L
from ..operators import splits as S
from ..sources import market as M
from .feature_queries import GRID, KEYS, RANGES, guard
from .query import query


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY ticker ORDER BY session_id)"


_H = (1, 5, 21)
query("l01_forward_returns", KEYS, " ".join(f"fwd_ret_{h}" for h in _H), sql="SELECT ticker, session_id, " + ", ".join(f"ln({lead('open', 1 + h)}) - ln({lead('open')}) AS fwd_ret_{h}" for h in _H) + " FROM grid", tables=GRID)(lambda s, d: L.forward_returns(M.grid(s, d)))
query("l03_label_ends", "ticker session_id t_end_1 t_end_5 t_end_21", sql="SELECT ticker, session_id, " + ", ".join(f"{lead('session_id', 1 + h)} AS t_end_{h}" for h in _H) + " FROM grid", tables=GRID)(lambda s, d: L.forward_returns(M.grid(s, d)))
query("l04_holding_return", KEYS, "next_open next_close", sql=f"SELECT ticker, session_id, ln({lead('open', 2)}) - ln({lead('open')}) AS next_open, ln({lead('close', 2)}) - ln({lead('close')}) AS next_close FROM grid", tables=GRID)(
    lambda s, d: M.grid(s, d).withColumns({"next_open": L.holding_return("open"), "next_close": L.holding_return("close")})
)
query("p16_simple_return", KEYS, "simple", sql=f"SELECT ticker, session_id, exp(ln({lead('open', 2)}) - ln({lead('open')})) - 1 AS simple FROM grid", tables=GRID)(lambda s, d: M.grid(s, d).withColumn("simple", F.expm1(L.holding_return())))


def sigma_grid(spark, sf, span: int = 50):
    t = Trail()
    return M.grid(spark, sf).withColumn("r", t.diff(ln("close"))).withColumn("sigma", t.std("r", span))


SIGMA = f"{RANGES}, sg AS (SELECT *, {guard('stddev_samp({})', 'r', 50)} AS sigma FROM ranges)"
BARRIER = f"""{SIGMA},
paths AS (SELECT a.ticker, a.session_id, a.sigma * sqrt(10) AS width, e.open AS entry, b.session_id - a.session_id - 1 AS k, ln(b.open) - ln(e.open) AS x
  FROM sg a JOIN sg e ON e.ticker = a.ticker AND e.session_id = a.session_id + 1 JOIN sg b ON b.ticker = a.ticker AND b.session_id BETWEEN a.session_id + 2 AND a.session_id + 11
  WHERE a.sigma IS NOT NULL AND e.open IS NOT NULL),
touch AS (SELECT ticker, session_id, any_value(width) AS width, count(*) AS n, coalesce(min(CASE WHEN x >= width THEN k END), 11) AS u, coalesce(min(CASE WHEN x <= -width THEN k END), 11) AS d FROM paths GROUP BY ticker, session_id),
tb AS (SELECT t.*, CASE WHEN u <> d THEN least(u, d) ELSE 10 END AS k FROM touch t WHERE n = 10),
barrier AS (SELECT g.ticker, g.session_id, p.x AS tb_ret, CASE WHEN tb.u < tb.d THEN 1.0 WHEN tb.d < tb.u THEN -1.0 ELSE sign(p.x) END AS tb_label, CASE WHEN tb.k IS NOT NULL THEN g.session_id + 1 + tb.k END AS tb_end, g.sigma * sqrt(10) AS tb_barrier
  FROM sg g LEFT JOIN tb ON tb.ticker = g.ticker AND tb.session_id = g.session_id LEFT JOIN paths p ON p.ticker = g.ticker AND p.session_id = g.session_id AND p.k = tb.k)"""
query("l05_triple_barrier", "ticker session_id tb_end", "tb_label tb_ret tb_barrier", sql="SELECT * FROM barrier", tables=BARRIER)(lambda s, d: L.triple_barrier(sigma_grid(s, d)))


@query("l06_meta_labels", "ticker session_id meta", sql=f"SELECT b.ticker, b.session_id, CASE WHEN s.side <> 0 AND tb_ret IS NOT NULL THEN CASE WHEN s.side * tb_ret > 0 THEN 1 ELSE 0 END END AS meta FROM barrier b JOIN (SELECT ticker, session_id, CASE WHEN close > {guard('avg({})', 'close', 50)} THEN 1 ELSE 0 END AS side FROM grid) s ON s.ticker = b.ticker AND s.session_id = b.session_id", tables=BARRIER)
def _meta(spark, sf):
    t = Trail()
    side = F.when(F.col("close") > t.mean("close", 50), 1).otherwise(0)
    return L.triple_barrier(sigma_grid(spark, sf).withColumn("side", side)).withColumn("meta", L.meta_label(F.col("side"), F.col("tb_ret")))


@query(
    "l07_uniqueness", KEYS, "uniqueness",
    sql="SELECT b.ticker, b.session_id, avg(1.0 / c.n) AS uniqueness FROM barrier b LEFT JOIN cover c ON c.ticker = b.ticker AND c.u BETWEEN b.session_id + 1 AND b.tb_end - 1 GROUP BY b.ticker, b.session_id",
    tables=BARRIER + ", cover AS (SELECT s.ticker, s.session_id AS u, count(*) AS n FROM sg s JOIN barrier b ON b.ticker = s.ticker AND s.session_id BETWEEN b.session_id + 1 AND b.tb_end - 1 GROUP BY 1, 2)",
)
def _uniqueness(spark, sf):
    g = L.triple_barrier(sigma_grid(spark, sf)).select("ticker", "session_id", "tb_end")
    return L.average_uniqueness(g, g.select("session_id"), "tb_end")


def samples(spark, sf, h: int = 5):
    """session_id, t_end of the target's labels, unresolved ones too."""
    return L.forward_returns(M.target(spark, sf), (h,)).select("session_id", F.col(f"t_end_{h}").alias("t_end"))


SAMPLES = f"{GRID}, samples AS (SELECT session_id, {lead('session_id', 6)} AS t_end FROM grid WHERE ticker = 'ALL'), ends AS (SELECT session_id, coalesce(t_end, {S.NEVER}) AS t_end FROM samples)"
SPLIT = "split_id session_id role"


@query("v01_walk_forward", SPLIT + " refit", sql="SELECT split_id, session_id, role, refit FROM (SELECT r.split_id, s.session_id, 'train' AS role, r.refit FROM refits r JOIN samples s ON s.session_id < r.refit AND s.t_end < r.refit UNION ALL SELECT t.split_id, t.session_id, 'test', r.refit FROM tests t JOIN refits r USING (split_id))", tables=SAMPLES + ", tests AS (SELECT session_id, CAST(floor((row_number() OVER (ORDER BY session_id) - 1) / 126) AS INTEGER) AS split_id FROM samples WHERE session_id >= 1500), refits AS (SELECT split_id, min(session_id) AS refit FROM tests GROUP BY split_id)")
def _walk(spark, sf):
    s = samples(spark, sf)
    return S.walk_forward(s.where("session_id >= 1500"), s, 126)


@query("v01b_rolling", SPLIT, sql="SELECT split_id, session_id, role FROM (SELECT split_id, session_id, role FROM (SELECT r.split_id, s.session_id, 'train' AS role, row_number() OVER (PARTITION BY r.split_id ORDER BY s.session_id DESC) AS n FROM refits r JOIN samples s ON s.session_id < r.refit AND s.t_end < r.refit) WHERE n <= 400 UNION ALL SELECT split_id, session_id, 'test' FROM tests)", tables=SAMPLES + ", tests AS (SELECT session_id, CAST(floor((row_number() OVER (ORDER BY session_id) - 1) / 126) AS INTEGER) AS split_id FROM samples WHERE session_id >= 1500), refits AS (SELECT split_id, min(session_id) AS refit FROM tests GROUP BY split_id)")
def _rolling(spark, sf):
    s = samples(spark, sf)
    return S.walk_forward(s.where("session_id >= 1500"), s, 126, rolling=400)


FOLDS = lambda k: f"{SAMPLES}, folds AS (SELECT *, ntile({k}) OVER (ORDER BY session_id) - 1 AS fold FROM ends), spans AS (SELECT fold, min(session_id) AS first, greatest(max(t_end), max(session_id)) AS last FROM folds GROUP BY fold)"
_KEEP = "NOT ((f.session_id <= p.last AND f.t_end >= p.first) OR (f.session_id > p.last AND f.session_id <= p.last + 5))"


@query("v02_purged_kfold", SPLIT, sql=f"SELECT p.fold AS split_id, f.session_id, CASE WHEN f.fold = p.fold THEN 'test' ELSE 'train' END AS role FROM folds f CROSS JOIN spans p WHERE f.fold = p.fold OR {_KEEP}", tables=FOLDS(5))
def _kfold(spark, sf):
    return S.purged_kfold(samples(spark, sf), 5, 5)


_COMBOS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(itertools.combinations(range(6), 2)))


@query("v03_cpcv", SPLIT + " fold", sql=f"SELECT c.split_id, f.session_id, CASE WHEN f.fold IN (c.a, c.b) THEN 'test' ELSE 'train' END AS role, f.fold FROM folds f CROSS JOIN combos c JOIN spans p ON p.fold = c.a JOIN spans p2 ON p2.fold = c.b WHERE f.fold IN (c.a, c.b) OR ({_KEEP} AND {_KEEP.replace('p.', 'p2.')})", tables=FOLDS(6) + f", combos(split_id, a, b) AS (VALUES {_COMBOS})")
def _cpcv(spark, sf):
    return S.cpcv(spark, samples(spark, sf), 6, 2, 5)


@query("v04_unresolved", "session_id end_", sql="SELECT session_id, t_end AS end_ FROM ends", tables=SAMPLES)
def _unresolved(spark, sf):
    return samples(spark, sf).withColumn("end_", S.known_end(F.col("t_end")))


@query("j13_purge_join", "first last session_id", sql="SELECT p.first, p.last, e.session_id FROM (VALUES (100, 150), (400, 420), (1000, 1100)) p(first, last) JOIN ends e ON (e.session_id <= p.last AND e.t_end >= p.first) OR (e.session_id > p.last AND e.session_id <= p.last + 5)", tables=SAMPLES)
def _purged(spark, sf):
    spans = spark.createDataFrame([(100, 150), (400, 420), (1000, 1100)], "first int, last int")
    rows = samples(spark, sf).withColumn("end_", S.known_end(F.col("t_end")))
    return rows.join(F.broadcast(spans), S.overlap(F.col("session_id"), F.col("end_"), F.col("first"), F.col("last"), 5))


@query("j15_resolved_join", "refit session_id", sql="SELECT refit, session_id FROM (VALUES (500), (900)) r(refit) JOIN samples ON session_id < refit AND t_end < refit", tables=SAMPLES)
def _resolved(spark, sf):
    refits = spark.createDataFrame([(500,), (900,)], "refit int")
    return samples(spark, sf).join(F.broadcast(refits), (F.col("session_id") < F.col("refit")) & (F.col("t_end") < F.col("refit")))


