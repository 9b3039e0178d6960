"""Queries of models, harness, resampling, importance and generators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.windows import Trail, ln
from ..operators import features as X
from ..operators import generators as Y
from ..operators import labels as L
from ..operators import metrics as S
from ..operators import models as K
from ..operators import portfolio as P
from ..operators import resampling as B
from ..operators import splits as V
from ..operators import variance as H
from ..sources import market as M
from .feature_queries import RANGES, guard, lag
from .label_queries import lead
from .metric_queries import bench_run
from .portfolio_queries import SHARPE, bt_sql, forecasts, market_inputs
from .query import query

COLUMNS = ["ret_1", "ret_5", "ret_21", "ret_overnight", "ret_intraday", "rev_z5", "bb_pctb_20", "volume_z"]
#: Replicates of every bootstrap, and random paths.
REPS = 1000


def learning_frame(spark, sf):
    """session_id, features, y (label in units of volatility), t_end of the target, on the driver: a row for each session."""
    g = M.target(spark, sf)
    t = Trail()
    f = X.build(g, ["returns", "momentum", "bollinger", "volume"]).select("session_id", *COLUMNS)
    lab = g.withColumn("r", t.diff(ln("close"))).withColumn("sigma", t.std("r", 63))
    lab = L.forward_returns(lab, (1,), F.col("sigma")).select("session_id", F.col("fwd_ret_vn_1").alias("y"), F.col("t_end_1").alias("t_end"), "sigma", F.col("fwd_ret_1").alias("raw"))
    return f.join(lab, "session_id").toPandas().sort_values("session_id")


def _harness(models, **how):
    return lambda spark, sf: K.walk_forward(spark, learning_frame(spark, sf), COLUMNS, models, **how)


query("m03_autoregression", "model session_id refit", "pred")(_harness({"ar": ("ar", {})}, every=21))
query("m04_linear", "model session_id refit", "pred")(_harness({"ridge": ("ridge", {}), "elastic_net": ("elastic_net", {})}, every=21))
query("m05_boosted", "model session_id refit", "pred")(_harness({"boosted": ("boosted", {"trees": 300})}, every=21))
query("m07_tuned_boosted", "model session_id refit", "pred")(_harness({"tuned": ("boosted", {})}, every=21, tune={"tuned": 12}))
query("m18c_boosted_variance", "ticker session_id", "var")(lambda s, d: H.boosted_forecasts(M.target(s, d), X.build(M.target(s, d), ["returns", "momentum", "bollinger", "volume"]), COLUMNS))
_NET = {"epochs": 40, "seeds": 3, "hidden": 16}
query("m09_lstm", "model session_id refit", "pred")(_harness({"lstm": ("lstm", _NET), "lstm_quantile": ("lstm", _NET | {"head": "quantile"})}, every=126))
query("m09b_gru", "model session_id refit", "pred")(_harness({"gru": ("gru", _NET), "gru_quantile": ("gru", _NET | {"head": "quantile"})}, every=126))
query("m09c_tcn", "model session_id refit", "pred")(_harness({"tcn": ("tcn", _NET | {"length": 32})}, every=126))
query("m16_harness", "model session_id refit", "pred")(_harness({"zero": ("zero", {}), "hist_mean": ("hist_mean", {}), "ar": ("ar", {}), "ridge": ("ridge", {})}, every=21))


_LR = f"""{RANGES}, lr AS (SELECT r AS a, ln(open) - ln({lag('close')}) AS b, ln({lead('open', 2)}) - ln({lead('open')}) AS y, ticker FROM ranges),
ok AS (SELECT * FROM lr WHERE ticker = 'ALL' AND a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
st AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS c, covar_pop(a, y) / stddev_pop(a) AS p, covar_pop(b, y) / stddev_pop(b) AS q, 1 + 10.0 / count(*) AS d FROM ok),
co AS (SELECT *, (d * p - c * q) / (d * d - c * c) / sa AS wa, (d * q - c * p) / (d * d - c * c) / sb AS wb FROM st)"""


@query("m04b_ridge_gram", "term", "coef", sql="SELECT 'const' AS term, my - ma * wa - mb * wb AS coef FROM co UNION ALL SELECT 'ret_1', wa FROM co UNION ALL SELECT 'ret_overnight', wb FROM co", tables=_LR)
def _gram(spark, sf):
    """Ridge of the next return on two features, from one aggregate of products."""
    rows = learning_rows(spark, sf)
    xs = ["ret_1", "ret_overnight"]
    g = S.gram_matrix(S.gram(rows, xs, "y").first(), 4)
    n = g[0, 0]
    mean = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(c)[:2])
    coef = np.linalg.solve(c[:2, :2] / np.outer(sd, sd) + 10.0 / n * np.eye(2), c[:2, 2] / sd) / sd
    return spark.createDataFrame([("const", float(mean[2] - mean[:2] @ coef)), *zip(xs, map(float, coef), strict=True)], "term string, coef double")


def learning_rows(spark, sf):
    f = X.build(M.target(spark, sf), ["returns"])
    y = L.forward_returns(M.target(spark, sf), (1,)).select("session_id", F.col("fwd_ret_1").alias("y"))
    return f.join(y, "session_id")


@query("m12_stacking", "session_id", "pred")
def _stacking(spark, sf):
    f = forecasts(spark, sf).where("model <> 'zero'").select("model", "session_id", "pred", "r").toPandas()
    wide = f.pivot(index="session_id", columns="model", values="pred")
    y = f.drop_duplicates("session_id").set_index("session_id")["r"]
    out, _ = K.stack(wide, y, y.index.to_series() + 2)
    return spark.createDataFrame([(int(i), float(v)) for i, v in out.items()], "session_id long, pred double")


@query("m17_meta_labelling", "session_id", "prob position")
def _meta(spark, sf):
    t = Trail()
    g = M.target(spark, sf).withColumns({"r": t.diff(ln("close")), "side": F.when(F.col("close") > t.mean("close", 50), 1).otherwise(0)}).withColumn("sigma", t.std("r", 50))
    tb = L.triple_barrier(g, vertical=5).withColumn("meta", L.meta_label(F.col("side"), F.col("tb_ret")))
    u = L.average_uniqueness(tb.select("ticker", "session_id", "tb_end"), tb.select("session_id"), "tb_end").select("session_id", "uniqueness")
    f = X.build(M.target(spark, sf), ["returns"]).select("session_id", "ret_1", "ret_5", "ret_21")
    return K.meta_positions(spark, tb.select("session_id", "side", F.col("meta").cast("double").alias("meta"), F.col("tb_end").cast("double").alias("tb_end")).join(u, "session_id").join(f, "session_id").toPandas(), ["ret_1", "ret_5", "ret_21"], every=252)


def returns_matrix(spark, sf):
    """(session ids, names, matrix) of benchmark returns on common dates: the calendar times a few strategies."""
    w = bench_run(spark, sf).select("strategy", "session_id", "net").toPandas().pivot(index="session_id", columns="strategy", values="net").dropna()
    return w.index.to_numpy(), list(w.columns), w.to_numpy()


def _row(spark, d):
    return spark.createDataFrame([(k, float(v)) for k, v in d.items()], "name string, value double")


query("r17_sharpe_bootstrap", "name", "value")(lambda s, d: (lambda m: _row(s, B.sharpe_interval(s, m[2][:, 0], REPS)))(returns_matrix(s, d)))
# Prices of this table are so wild that holding the target returns 450 % in the mean session, and a product of thousands of such returns leaves the doubles: returns are divided by 10,000.
query("r17b_equity_bootstrap", "name", "value")(lambda s, d: (lambda m: _row(s, B.equity_paths(s, m[2][:, 0] / 10000, REPS)))(returns_matrix(s, d)))
query("r20_superior_ability", "name", "value")(lambda s, d: (lambda m: _row(s, B.spa(s, m[2][:, 0], m[2][:, 1:], REPS)))(returns_matrix(s, d)))


@query("r11_confidence_set", "name", "value")
def _mcs(spark, sf):
    f = forecasts(spark, sf).where("r is not null").withColumn("loss", (F.col("r") - F.col("pred")) ** 2).select("model", "session_id", "loss").toPandas().pivot(index="session_id", columns="model", values="loss").dropna()
    return _row(spark, B.confidence_set(spark, f.to_numpy(), list(f.columns), REPS))


@query("e08_random_paths", "path", "exposure sharpe")
def _random(spark, sf):
    m = market_inputs(spark, sf).where("r is not null and session_id >= 300").select("session_id", "r").toPandas().sort_values("session_id")
    return P.random_paths(spark, m["r"].to_numpy(), REPS, 0.5, 20)


@query("r21_random_null", "", "best percentile")
def _null(spark, sf):
    """Where the trend rule's Sharpe lies among random long/flat paths of like exposure."""
    best = bench_run(spark, sf).where("strategy = 'trend_200'").agg(S.sharpe().alias("s"), F.avg("position").alias("p")).first()
    m = market_inputs(spark, sf).where("r is not null and session_id >= 300").select("session_id", "r").toPandas().sort_values("session_id")
    paths = P.random_paths(spark, m["r"].to_numpy(), REPS, min(0.95, max(0.05, best.p)), 20)
    return paths.agg(F.lit(best.s).alias("best"), F.avg((F.col("sharpe") < best.s).cast("double")).alias("percentile"))


@query("r22_importance", "fold name kind", "value")
def _importance(spark, sf):
    f = learning_frame(spark, sf)
    part = K.ward_clusters(f[COLUMNS].corr("spearman").to_numpy(), 4)
    groups = {c: [c] for c in COLUMNS} | {f"cluster_{k}": [c for c, p in zip(COLUMNS, part, strict=True) if p == k] for k in range(part.max() + 1)}
    return K.importance(spark, f, COLUMNS, groups, folds=5, repeats=5)


@query("r23_cpcv_paths", "path", "sharpe")
def _paths(spark, sf):
    """Sharpe of every combinatorial path of a ridge forecast with sign sizing; a task for each split."""
    import pandas as pd

    f = learning_frame(spark, sf).dropna(subset=[*COLUMNS, "y"]).reset_index(drop=True)
    samples = spark.createDataFrame([(int(a), int(b)) for a, b in zip(f["session_id"], f["t_end"], strict=True)], "session_id long, t_end long")
    sent = spark.sparkContext.broadcast((f["session_id"].to_numpy(), f[COLUMNS].to_numpy(float), f["y"].to_numpy(float)))

    def fit(p):
        ids, A, y = sent.value
        tr, te = (np.searchsorted(ids, np.sort(p.loc[p["role"] == r, "session_id"])) for r in ("train", "test"))
        m = K.make("ridge", alphas=(100.0,)).fit(A[tr], y[tr])
        folds = p.set_index("session_id")["fold"].reindex(ids[te]).to_numpy()
        return pd.DataFrame({"split_id": p["split_id"].iloc[0], "fold": folds, "session_id": ids[te], "pred": m.predict(A[te])})

    pred = V.cpcv(spark, samples, 6, 2, 5).groupBy("split_id").applyInPandas(fit, "split_id int, fold int, session_id long, pred double")
    chosen = spark.createDataFrame([(k, g, i) for k, path in enumerate(V.cpcv_paths(6, 2)) for g, i in path], "path int, fold int, split_id int")
    rows = pred.join(F.broadcast(chosen), ["fold", "split_id"]).join(market_inputs(spark, sf).select("session_id", "r", "sigma", "adv"), "session_id").where("adv is not null and sigma is not null")
    bt = P.backtest(rows.withColumn("position", (F.col("pred") > 0).cast("double")), by=("path",))
    return bt.groupBy("path").agg(S.sharpe().alias("sharpe"))


_STUDY = f"""{RANGES},
p0 AS (SELECT ticker, session_id, r AS lr, ln({lead('open', 2)}) - ln({lead('open')}) AS r, close * volume AS dollar, CASE WHEN close > {guard('avg({})', 'close', 50)} THEN 1.0 ELSE 0.0 END AS side FROM ranges),
p1 AS (SELECT *, {guard('stddev_samp({})', 'lr', 63)} AS sigma, {guard('avg({})', 'dollar', 20)} AS a FROM p0),
p2 AS (SELECT *, {lag('a')} AS adv FROM p1),
study AS (SELECT ticker || '/' || kind AS strategy, session_id, position, r, sigma, adv FROM (SELECT *, 'trend' AS kind, side AS position FROM p2 UNION ALL SELECT *, 'buy_hold', 1.0 FROM p2) WHERE session_id >= 300 AND sigma IS NOT NULL AND adv IS NOT NULL),
{bt_sql('study')}"""


@query("r24_peer_study", "ticker", "trend buy_hold", sql=f"SELECT split_part(strategy, '/', 1) AS ticker, max(s) FILTER (strategy LIKE '%/trend') AS trend, max(s) FILTER (strategy LIKE '%/buy_hold') AS buy_hold FROM (SELECT strategy, {SHARPE} AS s FROM bt GROUP BY strategy) GROUP BY 1", tables=_STUDY)
def _peers(spark, sf):
    """The trend rule on every ticker in one plan: the ticker is a key, not a loop."""
    t = Trail()
    m = market_inputs(spark, sf, None).withColumn("side", F.when(F.col("close") > t.mean("close", 50), 1.0).otherwise(0.0)).where("session_id >= 300 and sigma is not null and adv is not null")
    both = m.select("ticker", "session_id", "r", "sigma", "adv", F.explode(F.map_from_arrays(F.array(F.lit("trend"), F.lit("buy_hold")), F.array("side", F.lit(1.0)))).alias("strategy", "position"))
    bt = P.backtest(both, by=("ticker", "strategy"))
    s = bt.groupBy("ticker", "strategy").agg(S.sharpe().alias("s"))
    return s.groupBy("ticker").agg(*[F.max(F.when(F.col("strategy") == n, F.col("s"))).alias(n) for n in ("trend", "buy_hold")])


query("c10_metadata", "name grp lookback exogenous lag known_ahead")(lambda s, d: s.createDataFrame([(m["name"], m["group"], m["lookback"], m["exogenous"], m["lag"], m["known_ahead"]) for m in X.metadata()], "name string, grp string, lookback int, exogenous boolean, lag int, known_ahead int"))


@query("m13_regime_fit", "state", "mean volatility stay")
def _regime_fit(spark, sf):
    from ..operators.recursions import hmm_fit, regime_inputs

    rows = regime_inputs(M.target(spark, sf)).select("session_id", "ret", "log_range").toPandas().sort_values("session_id")
    m = hmm_fit(rows[["ret", "log_range"]].to_numpy(float), iterations=200)
    return spark.createDataFrame([(k, float(m["mean"][k, 0]), float(m["cov"][k, 0, 0] ** 0.5), float(m["trans"][k, k])) for k in range(2)], "state int, mean double, volatility double, stay double")


query("y01_gbm", "session_id", "price")(lambda s, d: Y.gbm(s, 500))
query("y02_garch", "seed session_id", "ret variance")(lambda s, d: Y.garch(s, 500, seeds=(0, 1)))
query("y03_regime_switching", "seed session_id state", "ret")(lambda s, d: Y.regime_switching(s, 500, seeds=(0, 1)))
query("y04_planted_signal", "session_id", "x0 x1 y")(lambda s, d: Y.planted_signal(s, 500))
query("y05_synthetic_market", "ticker session_id date", "open high low close volume")(lambda s, d: Y.market(s, 300))
