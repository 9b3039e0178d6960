"""Features do not move when the future does; labels depend on data up to their end."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideglass.functions.windows import Trail
from tideglass.operators import features as X
from tideglass.operators import generators, labels, recursions
from tideglass.plans.lint import BASE, lint_features, looks_ahead


@pytest.fixture(scope="module")
def bars(spark):
    return generators.market(spark, 420, signal=0.2, seed=11).where("ticker = 'ALL'").toPandas().sort_values("session_id")


def perturbed(bars, cuts, seed=1):
    """A ticker for each cut: its values after the cut are multiplied by noise."""
    rng, out = np.random.default_rng(seed), []
    for c in cuts:
        b = bars.copy()
        b["ticker"] = f"cut{c}"
        later = b["session_id"] > c
        for col in ("open", "high", "low", "close", "volume"):
            b.loc[later, col] *= np.exp(0.5 * rng.standard_normal(later.sum()))
        out.append(b)
    return pd.concat([bars, *out])


CUTS = [5, 70, 200, 300, 333, 400, 418]


def test_no_feature_looks_ahead(spark, bars):
    frame = spark.createDataFrame(perturbed(bars, CUTS))
    own = [n for n, s in X.SPECS.items() if not s.needs]
    got = X.build(frame, own).join(recursions.technical(frame), ["ticker", "session_id"]).drop("date", "high", "low", "close").toPandas().set_index(["ticker", "session_id"])
    base = got.loc["ALL"]
    assert (base.notna().sum() > 0).all()
    for c in CUTS:
        other = got.loc[f"cut{c}"]
        a, b = base[base.index <= c].sort_index(), other[other.index <= c].sort_index()
        np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, equal_nan=True)
        assert c > 410 or not np.allclose(base[base.index > c].sort_index()["ret_1"], other[other.index > c].sort_index()["ret_1"])


def test_labels_end_when_they_say(spark, bars):
    frame = spark.createDataFrame(perturbed(bars, CUTS)).withColumn("sigma", F.lit(0.02))
    lab = labels.triple_barrier(labels.forward_returns(frame, (1, 5)), vertical=5).toPandas().set_index(["ticker", "session_id"]).sort_index()
    base = lab.loc["ALL"]
    for c in CUTS:
        other = lab.loc[f"cut{c}"]
        for value, end in (("fwd_ret_1", "t_end_1"), ("fwd_ret_5", "t_end_5"), ("tb_ret", "tb_end")):
            done = base[end] <= c
            np.testing.assert_allclose(base.loc[done, value], other.loc[done, value], rtol=1e-12)


def test_lint_is_clean_and_bites(spark):
    assert lint_features(spark) == {}
    frame = spark.createDataFrame([], BASE)
    w = Trail().window
    assert looks_ahead(frame.withColumn("x", F.lead("close").over(w)))
    assert looks_ahead(frame.withColumn("x", F.max("close").over(w.rowsBetween(-2, 1))))
    assert looks_ahead(frame.withColumn("x", F.max("close").over(w.rowsBetween(0, Window.unboundedFollowing))))
    assert not looks_ahead(frame.withColumn("x", F.max("close").over(w.rowsBetween(-2, 0))))


def test_registry_refuses():
    with pytest.raises(ValueError, match="two features"):
        X.feature("returns", "again")(lambda t, p: [{}])
    with pytest.raises(ValueError):
        X.Params(exogenous_lag=0)
    with pytest.raises(ValueError):
        Trail().lag("x", -1)


def test_exogenous_specs_are_lagged():
    assert {m["name"] for m in X.metadata() if m["exogenous"]} == {"beta_corr", "fund_returns", "peers", "macro"}
    assert all(m["lag"] >= 1 for m in X.metadata() if m["exogenous"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0.1, 10)), min_size=30, max_size=60), st.integers(0, 59))
def test_hidden_states_are_filtered_not_smoothed(values, cut):
    x = np.array([[np.nan if v is None else np.log(v), 0.1] for v in values])
    m = {"start": np.array([0.5, 0.5]), "trans": np.array([[0.9, 0.1], [0.2, 0.8]]), "mean": np.array([[0.0, 0.0], [0.5, 0.2]]), "cov": np.array([np.eye(2), 2 * np.eye(2)]), "center": np.zeros(2), "scale": np.ones(2)}
    full = recursions.hmm_filter(x, m)
    part = recursions.hmm_filter(x[: cut + 1], m)
    np.testing.assert_allclose(full[: cut + 1], part)
    np.testing.assert_allclose(full.sum(axis=1), 1)
