"""The research pipeline by stages: data, features, train, backtest, evaluate, report; and the lockbox.

Stages talk through Parquet and JSON under ``work_dir``, so each can be rerun.
Development stages never read past the lockbox's start; every fit is logged as
a trial.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import Trail, ln
from ..operators import features as X
from ..operators import generators, labels, metrics, models, portfolio, quality, recursions, resampling
from ..sources import market as M
from ..sources import store
from .config import Config, as_dict

STAGES = ("data", "data-report", "features", "train", "backtest", "evaluate", "report")


class Research:
    def __init__(self, spark: SparkSession, cfg: Config):
        self.spark, self.cfg = spark, cfg
        self.registry = store.Registry(spark, f"{cfg.work_dir}/registry")
        self.run_id = uuid.uuid4().hex[:12]

    def path(self, name: str) -> str:
        return f"{self.cfg.work_dir}/{name}"

    def data(self) -> DataFrame:
        """Raw bars, one directory for each ticker, and a manifest."""
        c = self.cfg
        bars = M.bars(self.spark, c.data_dir) if c.source == "trades" else generators.market(self.spark, c.sessions, signal=c.signal, seed=c.seed, start="2019-01-02").drop("session_id")
        store.write_bars(bars, self.path("bars"))
        entries = store.file_hashes(self.spark, self.path("bars"))
        store.write_json(self.spark, self.path("manifest.json"), [r.asDict() for r in entries.orderBy("path").collect()])
        return entries

    def grid(self, everything: bool = False) -> DataFrame:
        b = quality.validate(store.read_bars(self.spark, self.path("bars")))
        if not everything:
            b = b.where(F.col("date") < F.to_date(F.lit(self.cfg.lockbox_start)))
        return M.on_grid(b)

    def data_report(self) -> dict:
        rep = quality.report(self.grid())
        store.write_json(self.spark, self.path("quality.json"), rep)
        store.write_text(self.spark, self.path("quality.md"), quality.report_markdown(rep))
        return rep

    def target(self, everything: bool = False) -> DataFrame:
        return self.grid(everything).where(F.col("ticker") == M.TARGET)

    def features(self, everything: bool = False) -> DataFrame:
        """The feature store of the target: built on all history, labels with their ends."""
        g = self.target(everything)
        f = X.build(g, [n for n, s in X.SPECS.items() if not s.needs])
        f = f.join(recursions.technical(g).select("session_id", "rsi_14", "macd_hist", "atr_14"), "session_id")
        sigma = recursions.ex_ante_vol(g)
        lab = labels.forward_returns(sigma, sigma=F.col("sigma")).drop("open", "high", "low", "close", "volume")
        info = {"config": as_dict(self.cfg), "columns": len(f.columns) - 3, "everything": everything}
        store.save_store(self.spark, self.path("lockbox_store" if everything else "store"), f, lab, X.metadata(), info)
        return f

    def frame(self, name: str = "store") -> tuple[Any, list[str]]:
        f, lab, _, _ = store.load_store(self.spark, self.path(name))
        columns = [c for c in f.columns if c not in ("ticker", "session_id", "date")]
        rows = f.join(lab.select("session_id", F.col("fwd_ret_vn_1").alias("y"), F.col("t_end_1").alias("t_end"), "sigma", F.col("fwd_ret_1").alias("raw")), "session_id")
        return rows.toPandas().sort_values("session_id"), columns

    def train(self, only: str | None = None, store_name: str = "store", out: str = "forecasts", first: int | None = None) -> DataFrame:
        c = self.cfg
        frame, columns = self.frame(store_name)
        chosen = {m: (m, {}) for m in c.models if only in (None, m)}
        pred = models.walk_forward(self.spark, frame, columns, chosen, first=c.cv.initial_train if first is None else first, every=c.cv.retrain_every, rolling=c.cv.rolling_window if c.cv.scheme == "rolling" else None)
        scale = self.spark.createDataFrame(frame[["session_id", "sigma"]])
        done = pred.join(scale, "session_id").withColumn("pred_vn", F.col("pred")).withColumn("pred", F.col("pred") * F.col("sigma")).drop("sigma")
        done.write.mode("overwrite").partitionBy("model").parquet(self.path(out))
        for m in chosen:
            self.registry.log("model", m, {"model": m, **as_dict(c)["cv"]}, {}, self.run_id)
        return self.spark.read.parquet(self.path(out))

    def market(self, everything: bool = False) -> DataFrame:
        t = Trail()
        g = self.target(everything).withColumns({"lr": t.diff(ln("close")), "r": labels.holding_return(), "dollar": F.col("close") * F.col("volume")})
        return g.withColumns({"sigma": t.std("lr", 63), "a": t.mean("dollar", 20)}).withColumn("adv", t.lag("a"))

    def inputs(self, everything: bool = False) -> DataFrame:
        """What sizing and costs need, written once; the variance is that of the GJR model with t errors, p_high that of the regime filter."""
        first, path = self.cfg.cv.initial_train, self.path("lockbox_inputs" if everything else "inputs")
        g = self.market(everything)
        var = recursions.garch_forecasts(g, ("gjr_t",), first=first - 1).select("session_id", "var")  # the first return is of the second session
        p_high = recursions.regime_probability(self.target(everything), first=first).select("session_id", "p_high")
        rows = g.join(var, "session_id", "left").join(p_high, "session_id", "left")
        rows.select("session_id", "date", "r", "sigma", "adv", "var", "p_high").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def backtest(self, forecasts: str = "forecasts", out: str = "backtest", everything: bool = False) -> DataFrame:
        """All strategies through both engines; they must agree."""
        c = self.cfg
        f = self.spark.read.parquet(self.path(forecasts)).select("model", "session_id", "pred")
        rows = f.join(self.inputs(everything), "session_id").where("sigma is not null and adv is not null")
        portfolio.check_variance(rows)
        z, k = portfolio.Sizing(**as_dict(c)["sizing"]), portfolio.Costs(**as_dict(c)["costs"])
        pos = portfolio.positions(rows, portfolio.rules(self.spark), z)
        bt = portfolio.backtest(pos, k, check=True).select("strategy", "session_id", "date", "position", "turnover", "gross", "costs", "net")
        bt.write.mode("overwrite").parquet(self.path(out))
        bt = self.spark.read.parquet(self.path(out))
        worst = portfolio.engine_difference(bt, portfolio.event_backtest(pos, k)).agg(F.max("difference")).first()[0]
        if worst is None or worst > 1e-10:
            raise RuntimeError(f"the engines differ by {worst}")
        for r in bt.groupBy("strategy").agg(metrics.sharpe().alias("s")).collect():
            self.registry.log("strategy", r.strategy, {"strategy": r.strategy}, {"sharpe": r.s if r.s is not None else float("nan")}, self.run_id)
        return bt

    def evaluate(self, name: str = "backtest", forecasts: str = "forecasts", out: str = "evaluation.json", everything: bool = False) -> dict:
        c = self.cfg
        bt = self.spark.read.parquet(self.path(name))
        perf = [r.asDict() for r in metrics.performance(bt).orderBy("strategy").collect()]
        f = self.spark.read.parquet(self.path(forecasts)).select("model", "session_id", "pred").join(self.market(everything).select("session_id", "r"), "session_id")
        ics = [r.asDict() for r in metrics.information_coefficient(f).orderBy("model").collect()]
        ranked = [p for p in perf if p["sharpe"] is not None]
        if not ranked:
            raise ValueError("no strategy has a Sharpe ratio")
        best = max(ranked, key=lambda p: p["sharpe"])["strategy"]
        trials = store.distinct_trials(self.registry.select("strategy")).count()
        x = bt.where(F.col("strategy") == best).orderBy("session_id").select("net").toPandas()["net"].to_numpy()
        result = {
            "performance": perf, "information": ics, "best": best, "trials": trials, "deflated": metrics.deflated_sharpe(bt, best, trials),
            "interval": resampling.sharpe_interval(self.spark, x, c.evaluation.reps, c.seed), "equity": resampling.equity_paths(self.spark, x, c.evaluation.reps, c.seed),
            "pbo": metrics.pbo(self.spark, bt.select("strategy", "session_id", "net"), c.evaluation.pbo_blocks).agg(F.avg((F.col("logit") <= 0).cast("double"))).first()[0],
            "last_session": str(bt.agg(F.max("date")).first()[0]),
        }
        store.write_json(self.spark, self.path(out), result)
        return result

    def report(self) -> str:
        """results.json and a markdown page; a missing stage is an error."""
        result = {"quality": store.read_json(self.spark, self.path("quality.json")), "evaluation": store.read_json(self.spark, self.path("evaluation.json"))}
        result["strategies"] = sorted(result["evaluation"]["performance"], key=lambda p: -(p["sharpe"] or -9e9))
        store.write_json(self.spark, self.path("results.json"), result)
        lines = ["# Results", "", f"Best: {result['evaluation']['best']}, of {result['evaluation']['trials']} trials.", "", "| strategy | Sharpe | drawdown | turnover |", "| --- | --- | --- | --- |"]
        lines += [f"| {p['strategy']} | {p['sharpe']:.2f} | {p['max_drawdown']:.1%} | {p['turnover_ann']:.1f} |" for p in result["strategies"] if p["sharpe"] is not None]
        page = "\n".join(lines) + "\n"
        store.write_text(self.spark, self.path("RESULTS.md"), page)
        return page

    def lockbox(self, force: bool = False, reason: str = "") -> dict:
        """The one look at the held-back sessions: recorded before anything is computed."""
        box = store.Lockbox(self.spark, self.path("lockbox.json"))
        box.open(force, reason)
        self.features(everything=True)
        first = self.grid(True).where(F.col("date") >= F.to_date(F.lit(self.cfg.lockbox_start))).agg(F.min("session_id")).first()[0]
        self.train(store_name="lockbox_store", out="lockbox_forecasts", first=first)
        self.backtest("lockbox_forecasts", "lockbox_backtest", True)
        result = self.evaluate("lockbox_backtest", "lockbox_forecasts", "lockbox_evaluation.json", True)
        box.complete()
        return result

    def run(self, stage: str, **how: Any) -> Any:
        if stage == "reproduce":
            for s in STAGES:
                self.run(s)
            return None
        return getattr(self, stage.replace("-", "_"))(**how)


def inject(text: str, name: str, block: str) -> str:
    """Replace what stands between a page's markers."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if begin not in text or end not in text:
        raise ValueError(f"the page has no block {name}")
    return text[: text.index(begin) + len(begin)] + "\n" + block.strip("\n") + "\n" + text[text.index(end) :]
