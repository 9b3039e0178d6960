"""Hand values, closed forms and recovery of planted truth."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.functions import dist
from tideglass.operators import features, generators, labels, metrics, models, portfolio, quality, recursions, resampling, splits


def series(spark, values, name="net", **more):
    return spark.createDataFrame(pd.DataFrame({"strategy": "s", "session_id": range(len(values)), name: values, **more}))


def test_distributions():
    assert dist.norm_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert dist.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert dist.t_ppf(0.05, 5) == pytest.approx(-2.015048373, abs=1e-8)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert dist.f_sf(3.885293835, 2, 12) == pytest.approx(0.05, abs=1e-7)
    assert recursions.mackinnon_p(-2.86) == pytest.approx(0.05, abs=0.003)


def test_significance_hand_values():
    """Worked out from the formulas with the standard library's normal distribution."""
    normal, gamma = statistics.NormalDist(), 0.5772156649015329
    # 0.2 a period over 101: z = 0.2 * 10 / sqrt(1 + 0.3 * 0.2 + (4 - 1) / 4 * 0.04)
    assert metrics.psr(0.2, 101, -0.3, 4) == pytest.approx(normal.cdf(2 / math.sqrt(1.09)), abs=1e-12)
    most = 0.2 * ((1 - gamma) * normal.inv_cdf(1 - 1 / 37) + gamma * normal.inv_cdf(1 - 1 / (37 * math.e)))
    assert metrics.expected_max_sharpe(37, 0.04) == pytest.approx(most, abs=1e-9)
    assert metrics.min_track_record(-0.05, -0.3, 4) == math.inf


def test_weights_of_fractional_differences():
    assert recursions.ffd_weights(1.0) == [1.0, -1.0]
    assert recursions.ffd_weights(0.0) == [1.0]


def test_uniqueness_of_two_labels(spark):
    days = spark.range(6).select(F.col("id").alias("session_id"))
    rows = spark.createDataFrame([("t", 0, 3), ("t", 1, 4), ("t", 2, None)], "ticker string, session_id long, t_end long")
    got = {r.session_id: r.uniqueness for r in labels.average_uniqueness(rows, days).collect()}
    assert got == {0: 0.75, 1: 0.75, 2: None}


def test_meta_labels(spark):
    rows = spark.createDataFrame([(0.01, 1), (-0.02, 1), (0.03, 0), (None, 1)], "ret double, side int")
    assert [r[0] for r in rows.select(labels.meta_label(F.col("side"), F.col("ret"))).collect()] == [1, 0, None, None]


def test_third_friday(spark):
    assert str(spark.sql("select date'2024-06-11' as d").select(features.third_friday(F.col("d"))).first()[0]) == "2024-06-21"


def test_vol_target(spark):
    rows = spark.createDataFrame([("m", 0, 0.1, 0.0004, None)], "model string, session_id long, pred double, var double, p_high double")
    got = {r.rule: r.position for r in portfolio.positions(rows, portfolio.rules(spark)).collect()}
    assert got["voltarget"] == pytest.approx(min(0.35 / (0.02 * math.sqrt(252)), 1.5))
    assert got["voltarget_regime"] == 0 and got["sign"] == got["sign_ls"] == 1 and got["scaled"] == 0
    with pytest.raises(ValueError):
        portfolio.check_variance(rows.withColumn("var", F.lit(0.0)))


def book(spark, position, r):
    n = len(r)
    rows = series(spark, position, "position", r=np.array(r, float), sigma=np.full(n, 0.02), adv=np.full(n, 1e8))
    return rows.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def test_engines_agree_and_obey(spark):
    rng = np.random.default_rng(0)
    r = list(0.01 * rng.standard_normal(60))
    r[7] = None
    wild = book(spark, list(rng.uniform(-1.5, 1.5, 60)), r)
    a, b = portfolio.backtest(wild), portfolio.event_backtest(wild)
    assert portfolio.engine_difference(a.select("strategy", "session_id", "net", "costs", "gross", "position"), b).first().difference < 1e-12
    flat = portfolio.backtest(book(spark, [0.0] * 60, r)).agg(F.sum(F.abs("net"))).first()[0]
    assert flat == 0
    held = portfolio.backtest(book(spark, [1.0] * 60, r)).orderBy("session_id").collect()
    assert sum(x.costs > 0 for x in held) == 1 and sum(x.gross for x in held) == pytest.approx(sum(math.expm1(v) for v in r if v is not None))
    cheap = portfolio.backtest(wild, portfolio.Costs(half_spread_bps=0, slippage=0, impact=0)).agg(F.sum("net")).first()[0]
    assert cheap > a.agg(F.sum("net")).first()[0]
    short = portfolio.backtest(book(spark, [-1.0] * 60, r), portfolio.Costs(half_spread_bps=0, commission_bps=0, slippage=0, impact=0)).agg(F.sum("costs")).first()[0]
    assert short == pytest.approx(59 * 30e-4 / 252)
    with pytest.raises(ValueError):
        portfolio.backtest(wild.withColumn("adv", F.lit(None).cast("double")), check=True)


def test_performance_against_pandas(spark):
    x = pd.Series(0.01 * np.random.default_rng(2).standard_normal(300) + 0.0005)
    got = metrics.performance(series(spark, x, position=1.0, turnover=0.1)).first()
    eq = (1 + x).cumprod()
    dd = eq / eq.cummax() - 1
    assert got.total_return == pytest.approx(eq.iloc[-1] - 1) and got.max_drawdown == pytest.approx(dd.min())
    assert got.sharpe == pytest.approx(x.mean() / x.std() * math.sqrt(252))
    assert got.kurtosis == pytest.approx(((x - x.mean()) ** 4).mean() / x.var(ddof=0) ** 2)
    assert got.turnover_ann == pytest.approx(0.1 * 252)
    run = longest = 0
    for v in dd:
        run = run + 1 if v < 0 else 0
        longest = max(longest, run)
    assert got.max_dd_duration == longest


def test_drawdown_starts_at_the_first_value(spark):
    d = metrics.drawdowns(series(spark, [-0.5, 0.0, 0.1])).orderBy("session_id").collect()
    assert [round(r.drawdown, 12) for r in d] == [0, 0, 0]
    d = metrics.drawdowns(series(spark, [0.1, -1.5, 0.2, -1.0])).orderBy("session_id").collect()
    assert [round(r.equity, 9) for r in d] == [1.1, -0.55, -0.66, 0]


def test_newey_west_against_numpy(spark):
    x = np.cumsum(np.random.default_rng(4).standard_normal(150)) * 0.1
    got = metrics.newey_west(series(spark, x), "net", ("strategy",)).first()
    e, n = x - x.mean(), len(x)
    lags = metrics.newey_west_lags(n)
    lrv = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    assert got.se == pytest.approx(math.sqrt(lrv / n))


def test_regression_recovers(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(400)
    y = 0.001 + 1.5 * x + 0.1 * rng.standard_normal(400)
    fit = metrics.ols(series(spark, y, x=x), ["x"], "net")
    assert fit["betas"]["x"]["beta"] == pytest.approx(1.5, abs=0.03) and fit["r2"] > 0.99
    assert metrics.ols(series(spark, y[:10], x=x[:10]), ["x"], "net") == {"n": 10}
    truth = metrics.ols(series(spark, x + 0.5 * rng.standard_normal(400), x=x), ["x"], "net")
    assert metrics.wald_unit(truth) > 0.01


def strategies(spark, matrix):
    rows = [(f"s{j:02d}", i, float(v)) for j, col in enumerate(matrix.T) for i, v in enumerate(col)]
    return spark.createDataFrame(rows, "strategy string, session_id long, net double")


def test_pbo(spark):
    rng = np.random.default_rng(6)
    m = 0.01 * rng.standard_normal((400, 6))
    m[:, 2] += 0.02
    got = metrics.pbo(spark, strategies(spark, m), 8).collect()
    assert len(got) == 70 and not any(r.logit <= 0 for r in got)
    # each of two strategies wins in half of four blocks and loses in the others
    a = np.concatenate([np.full(250, s) for s in (0.01, 0.01, -0.01, -0.01)]) + 0.001 * rng.standard_normal(1000)
    got = metrics.pbo(spark, strategies(spark, np.column_stack([a, -a])), 4).collect()
    assert len(got) == 6 and sum(r.logit <= 0 for r in got) / 6 >= 2 / 3


def test_splits_purge(spark):
    rng = np.random.default_rng(7)
    ends = [i + int(rng.integers(1, 12)) for i in range(200)]
    rows = spark.createDataFrame([(i, e if e < 200 else None) for i, e in enumerate(ends)], "session_id long, t_end long")
    end = {i: e if e < 200 else splits.NEVER for i, e in enumerate(ends)}
    for table, by in ((splits.purged_kfold(rows, 5, 5), None), (splits.cpcv(spark, rows, 6, 2, 5), "fold")):
        t = table.toPandas()
        for _, part in t.groupby("split_id"):
            train = part[part.role == "train"]["session_id"]
            tests = part[part.role == "test"]
            for _, g in tests.groupby(by) if by else [(0, tests)]:
                first, last = g["session_id"].min(), max(end[i] for i in g["session_id"])
                assert not any(i <= last and end[i] >= first or last < i <= last + 5 for i in train)
    sizes = splits.purged_kfold(rows, 3, 0).where("role = 'test'").groupBy("split_id").count().orderBy("split_id").collect()
    assert [r["count"] for r in sizes] == [67, 67, 66]
    assert splits.n_paths(6, 2) == 5 and len(splits.cpcv_paths(6, 2)) == 5
    walk = splits.walk_forward(rows.where("session_id >= 100"), rows, 30).toPandas()
    for _, part in walk.groupby("split_id"):
        assert all(end[i] < part.refit.iloc[0] for i in part[part.role == "train"].session_id)
    splits.check_positions(rows, rows)
    with pytest.raises(ValueError):
        splits.check_positions(rows.withColumn("session_id", F.col("session_id") + 500), rows)


def test_models_find_a_signal_and_no_noise(spark):
    f = generators.planted_signal(spark, 900, strength=0.5, seed=1).toPandas()
    X = f[[f"x{k}" for k in range(10)]].to_numpy()
    noise = np.random.default_rng(8).standard_normal(900)
    for kind in ("ridge", "elastic_net", "boosted"):
        fit = lambda y: np.corrcoef(models.make(kind).fit(X[:600], y[:600]).predict(X[600:]) + 1e-12 * noise[600:], y[600:])[0, 1]
        assert fit(f["y"].to_numpy()) > 0.35 and abs(fit(noise)) < 0.2
    w = models.Linear(alphas=(2.0,)).fit(X, f["y"].to_numpy())
    Z = (X - X.mean(0)) / X.std(0)
    assert np.allclose(w.coef, np.linalg.solve(Z.T @ Z + 2 * np.eye(10), Z.T @ (f["y"] - f["y"].mean())))
    with pytest.raises(KeyError):
        models.make("crystal_ball")


def test_boosted_contributions_and_nulls():
    rng = np.random.default_rng(9)
    X = rng.standard_normal((500, 3))
    X[::7, 1] = np.nan
    y = np.where(np.isnan(X[:, 1]), 2.0, X[:, 0])
    m = models.Boosted(60, 0.1, 3, 10).fit(X, y)
    assert np.mean((m.predict(X) - y) ** 2) < 0.1
    roots = m.rate * sum(t["value"] for t in m.forest)
    assert np.allclose(m.base + roots + m.contributions(X).sum(axis=1), m.predict(X))


def test_lstm_gradient():
    rng = np.random.default_rng(10)
    m = models.Recurrent(length=4, hidden=3)
    P = {"W": rng.normal(0, 0.3, (2, 12)), "U": rng.normal(0, 0.3, (3, 12)), "b": rng.normal(0, 0.1, 12), "V": rng.normal(0, 0.3, (3, 2)), "d": np.zeros(2)}
    S, y = rng.standard_normal((5, 4, 2)), rng.standard_normal(5)

    def loss():
        out, *_ = m.forward(P, S)
        return np.mean(0.5 * (out[:, 1] + (out[:, 0] - y) ** 2 * np.exp(-out[:, 1])))

    g = m.gradient(P, S, y)
    for name, at in (("W", (1, 5)), ("U", (2, 10)), ("b", 3), ("V", (0, 1)), ("d", 0)):
        old = P[name][at]
        P[name][at] = old + 1e-6
        up = loss()
        P[name][at] = old - 1e-6
        down = loss()
        P[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8)


def test_nnls_against_brute_force():
    import itertools

    rng = np.random.default_rng(11)
    for _ in range(20):
        A, b = rng.standard_normal((30, 4)), rng.standard_normal(30)
        best = np.inf
        for free in itertools.product([False, True], repeat=4):
            x = np.zeros(4)
            if any(free):
                x[list(free)] = np.linalg.lstsq(A[:, list(free)], b, rcond=None)[0]
            if (x >= 0).all():
                best = min(best, np.sum((A @ x - b) ** 2))
        x = models.nnls(A, b)
        assert (x >= 0).all() and np.sum((A @ x - b) ** 2) == pytest.approx(best)


def test_hidden_states_and_variances_recover(spark):
    r = generators.regime_switching(spark, 1500, seeds=(3,)).toPandas()
    m = recursions.hmm_fit(r[["ret"]].to_numpy())
    p = recursions.hmm_filter(r[["ret"]].to_numpy(), m)[:, 1]
    assert np.corrcoef(p, r["state"])[0, 1] > 0.6
    e, v = generators.garch_returns(1500, 0.05, 0.1, 0.85, 4)
    mean, scale, params = recursions.garch_fit("garch", e)
    got = recursions.garch_path("garch", (e - mean) / scale, params)[:-1] * scale**2
    assert np.corrcoef(np.log(got[100:]), np.log(v[100:]))[0, 1] > 0.9
    with pytest.raises(ValueError):
        generators.garch_returns(10, 0.1, 0.5, 0.6, 0)


def test_conformal_coverage(spark):
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame(pd.DataFrame({"model": "m", "session_id": range(800), "pred": 0.0, "r": rng.standard_normal(800)}))
    got = recursions.adaptive_conformal(rows).where("lower is not null").toPandas()
    assert 0.85 < ((got.r >= got.lower) & (got.r <= got.upper)).mean() < 0.95 and got.session_id.min() == 31


def test_bootstraps(spark):
    rng = np.random.default_rng(13)
    x = 0.01 * rng.standard_normal(400) + 0.001
    ci = resampling.sharpe_interval(spark, x, 100)
    assert ci["low"] < ci["sharpe"] < ci["high"] and ci["block"] >= 1
    m = 0.01 * rng.standard_normal((400, 4))
    better = m + np.array([0, 0, 0, 0.005])
    assert resampling.spa(spark, 0.01 * rng.standard_normal(400), better, 100)["spa_consistent"] < 0.05
    assert resampling.spa(spark, 0.01 * rng.standard_normal(400) + 0.002, m, 100)["spa_consistent"] > 0.2
    loss = rng.standard_normal((300, 3)) ** 2 + np.array([0, 0, 1.0])
    p = resampling.confidence_set(spark, loss, ["a", "b", "bad"], 100)
    assert p["bad"] < 0.1 and max(p["a"], p["b"]) == 1.0


def test_quality(spark):
    rows = [("t", i, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), *(400.0 if i < 30 else 100.0,) * 4, 1000.0 * (1 if i < 30 else 4)) for i in range(60)]
    raw = spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "session_id", "date", "open", "high", "low", "close", "volume"])).withColumn("date", F.to_date("date"))
    check = quality.split_check(raw, "2020-01-31", 4.0).first()
    assert not check.passed and check.close_ratio == pytest.approx(0.25)
    assert [r.session_id for r in quality.suspect_splits(raw).collect()] == [30]
    fixed = raw.withColumns({c: F.when(F.col("session_id") < 30, F.col(c) / 4).otherwise(F.col(c)) for c in ("open", "close", "high", "low")}).withColumn("volume", F.lit(4000.0))
    assert quality.split_check(fixed, "2020-01-31", 4.0).first().passed
    quality.validate(fixed)
    with pytest.raises(ValueError, match="t: "):
        quality.validate(fixed.withColumn("high", F.col("low") - 1))
    flat = features.build(fixed, ["volatility"]).where("log_rv_cc_21 is not null").count()
    assert flat == 0  # no logarithm of a volatility of zero
