"""Causal features: a registry of specs and the columns they make.

A spec gets a Trail and returns stages: dictionaries of columns, each stage
reading those before it (a window over a window needs two stages).  Building a
frame merges the stages of all specs, so one sort per ticker serves every
window, and a query's unused columns are pruned.  Specs that read other
tickers or macro series are exogenous: their output is lagged, one session at
least.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import Trail, ln, ratio
from ..sources import market

ANN = math.sqrt(252.0)
LN2 = math.log(2)


@dataclass(frozen=True)
class Params:
    horizons: tuple[int, ...] = (1, 5, 21, 63)
    vols: tuple[int, ...] = (21, 63)
    beta: int = 63
    zscore: int = 63
    exogenous_lag: int = 1
    earnings_cap: int = 20
    since_cap: int = 63
    exclude: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.exogenous_lag < 1:
            raise ValueError("exogenous inputs are lagged by one session at least")


Stages = list[dict[str, Column]]


@dataclass(frozen=True)
class Spec:
    name: str
    group: str
    make: Callable[[Trail, Params], Stages] = field(repr=False)
    lookback: int = 0
    exogenous: bool = False
    known_ahead: int = 0
    needs: tuple[str, ...] = ()
    description: str = ""


SPECS: dict[str, Spec] = {}


def feature(name: str, group: str, **how) -> Callable:
    def put(make: Callable[[Trail, Params], Stages]) -> Callable[[Trail, Params], Stages]:
        if name in SPECS:
            raise ValueError(f"two features are called {name}")
        SPECS[name] = Spec(name, group, make, description=(make.__doc__ or "").strip(), **how)
        return make

    return put


def build(frame: DataFrame, specs: list[str] | None = None, p: Params = Params(), keep: tuple[str, ...] = ("ticker", "session_id", "date")) -> DataFrame:
    """The columns of the given specs (all that the frame's columns allow) for every row of ``frame``."""
    t = Trail()
    chosen = [SPECS[n] for n in specs] if specs else [s for s in SPECS.values() if set(s.needs) <= set(frame.columns)]
    chosen = [s for s in chosen if s.name not in p.exclude]
    out: list[str] = []
    levels: list[dict[str, Column]] = []
    lagged: list[str] = []
    for s in chosen:
        stages = s.make(t, p)
        for k, stage in enumerate(stages):
            while len(levels) <= k:
                levels.append({})
            for name, column in stage.items():
                if name in levels[k] and not name.startswith("_") or name in out:
                    raise ValueError(f"two features make the column {name}")
                levels[k][name] = column
        out += [n for n in stages[-1] if not n.startswith("_")]
        if s.exogenous:
            lagged += [n for n in stages[-1] if not n.startswith("_")]
        for k, stage in enumerate(stages[:-1]):  # public columns of earlier stages
            out += [n for n in stage if not n.startswith("_")]
            if s.exogenous:
                lagged += [n for n in stage if not n.startswith("_")]
    if len(set(out)) != len(out):
        raise ValueError("two features make one column")
    for level in levels:
        frame = frame.withColumns(level)
    if lagged:
        frame = frame.withColumns({n: t.lag(n, p.exogenous_lag) for n in lagged})
    return frame.select(*keep, *[F.col(n).cast("double").alias(n) for n in out])


def metadata(p: Params = Params()) -> list[dict]:
    """One row for each registered spec, for documentation."""
    return [
        {"name": s.name, "group": s.group, "lookback": s.lookback, "exogenous": s.exogenous, "lag": p.exogenous_lag if s.exogenous else 0, "known_ahead": s.known_ahead, "description": s.description}
        for s in SPECS.values()
        if s.name not in p.exclude
    ]


@feature("returns", "returns", lookback=63)
def _returns(t: Trail, p: Params) -> Stages:
    """Log returns over several horizons, overnight and intraday."""
    out = {f"ret_{h}": t.diff(ln("close"), h) for h in p.horizons}
    return [out | {"ret_overnight": ln("open") - t.lag(ln("close")), "ret_intraday": ln("close") - ln("open")}]


def realized(t: Trail, w: int) -> dict[str, Column]:
    """Five annualised volatility estimators over w sessions; reads the _o.. _yo columns of ranges()."""
    k = 0.34 / (1.34 + (w + 1) / (w - 1))
    positive = lambda x: F.sqrt(F.greatest(x, F.lit(0.0))) * ANN
    guarded = lambda x: F.when(x.isNotNull(), positive(x))
    return {
        f"rv_cc_{w}": t.std("_r", w) * ANN,
        f"rv_park_{w}": guarded(t.mean("_park", w)),
        f"rv_gk_{w}": guarded(t.mean("_gk", w)),
        f"rv_rs_{w}": guarded(t.mean("_rs", w)),
        f"rv_yz_{w}": guarded(t.var("_yo", w) + k * t.var("_co", w) + (1 - k) * t.mean("_rs", w)),
    }


def ranges(t: Trail) -> dict[str, Column]:
    o, h, lo, c = (ln(x) for x in ("open", "high", "low", "close"))
    return {
        "_r": t.diff(c), "_co": c - o, "_yo": o - t.lag(c), "_park": (h - lo) ** 2 / (4 * LN2),
        "_gk": 0.5 * (h - lo) ** 2 - (2 * LN2 - 1) * (c - o) ** 2, "_rs": (h - o) * (h - c) + (lo - o) * (lo - c),
    }


@feature("volatility", "volatility", lookback=126)
def _volatility(t: Trail, p: Params) -> Stages:
    """Logs of five realised-volatility estimators, volatility of volatility, short over long."""
    raw: dict[str, Column] = {}
    for w in p.vols:
        raw |= realized(t, w)
    short, long_ = f"rv_cc_{min(p.vols)}", f"rv_cc_{max(p.vols)}"
    private = {f"_{n}": c for n, c in raw.items()}
    return [
        ranges(t),
        private,
        {f"log_{n}": ln(f"_{n}") for n in raw} | {"_dlog": t.diff(ln(f"_{short}")), "rv_ratio": ln(f"_{short}") - ln(f"_{long_}")},
        {"volvol_63": t.std("_dlog", 63)},
    ]


@feature("momentum", "momentum", lookback=252)
def _momentum(t: Trail, p: Params) -> Stages:
    """12-1 and 6-1 momentum, reversal in units of volatility, distance from moving averages."""
    lc = ln("close")
    return [
        {"_r": t.diff(lc)},
        {
            "mom_12_1": t.lag(lc, 21) - t.lag(lc, 252), "mom_6_1": t.lag(lc, 21) - t.lag(lc, 126),
            "rev_z5": -ratio(t.diff(lc, 5), t.std("_r", p.zscore) * math.sqrt(5)), "rev_z1": -ratio(t.diff(lc), t.std("_r", p.zscore)),
            "dist_ma50": lc - ln(t.mean("close", 50)), "dist_ma200": lc - ln(t.mean("close", 200)),
        },
    ]


@feature("bollinger", "technical", lookback=20)
def _bollinger(t: Trail, p: Params) -> Stages:
    """Place of the close in its 20-session band of two deviations."""
    return [{"bb_pctb_20": ratio(F.col("close") - (t.mean("close", 20) - 2 * t.std("close", 20)), 4 * t.std("close", 20))}]


@feature("volume", "volume", lookback=273)
def _volume(t: Trail, p: Params) -> Stages:
    """Volume z-score, Amihud illiquidity z-score, dollar volume against its year."""
    lv, dollar = ln("volume"), F.col("close") * F.col("volume")
    return [
        {"_lv": lv, "_ill": ratio(F.abs(t.diff(ln("close"))), F.when(dollar > 0, dollar)), "_dollar": dollar},
        {"_la": ln(t.mean("_ill", 21) * 1e9), "_ld": ln(t.mean("_dollar", 21)), "volume_z": ratio(F.col("_lv") - t.mean("_lv", p.zscore), t.std("_lv", p.zscore))},
        {"amihud_z": ratio(F.col("_la") - t.mean("_la", 252), t.std("_la", 252)), "dollar_vol_rel": F.col("_ld") - t.mean("_ld", 252)},
    ]


@feature("beta_corr", "cross_asset", lookback=63, exogenous=True, needs=("sector_close", "broad_close"))
def _beta_corr(t: Trail, p: Params) -> Stages:
    """Beta and correlation to the sector and the broad fund."""
    second: dict[str, Column] = {}
    for n in ("sector", "broad"):
        second[f"beta_{n}"] = ratio(t.pair(F.covar_samp, "_r", f"_r_{n}", p.beta), t.var(f"_r_{n}", p.beta))
        second[f"corr_{n}"] = t.pair(F.corr, "_r", f"_r_{n}", p.beta)
    return [{"_r": t.diff(ln("close"))} | {f"_r_{n}": t.diff(ln(f"{n}_close")) for n in ("sector", "broad")}, second]


@feature("fund_returns", "cross_asset", lookback=21, exogenous=True, needs=("sector_close", "broad_close", "index_close"))
def _fund_returns(t: Trail, p: Params) -> Stages:
    """Recent returns of the sector fund, the broad fund and the index."""
    return [{f"{n}_ret_{h}": t.diff(ln(f"{n}_close"), h) for n, h in (("sector", 1), ("sector", 5), ("broad", 5), ("index", 21))}]


@feature("peers", "cross_asset", lookback=21, exogenous=True, needs=("peer_mean_5", "peer_mean_21", "peer_std_21", "peer_mean_1"))
def _peers(t: Trail, p: Params) -> Stages:
    """Return against the mean of peers, and the peers' dispersion; peers without a price are skipped."""
    out = {f"rs_peers_{h}": t.diff(ln("close"), h) - F.col(f"peer_mean_{h}") for h in (5, 21)}
    return [out | {"peer_disp_21": F.col("peer_std_21"), "peer_ret_1": F.col("peer_mean_1")}]


@feature("macro", "macro", lookback=21, exogenous=True, needs=("vix", "vix3m", "dgs10", "dgs2"))
def _macro(t: Trail, p: Params) -> Stages:
    """Volatility index level, change and term structure; rate slope and changes."""
    return [
        {
            "vix_log": ln("vix"), "vix_chg_5": t.diff(ln("vix"), 5), "vix_term": ln("vix") - ln("vix3m"), "slope_10_2": F.col("dgs10") - F.col("dgs2"),
            "dgs10_chg_21": t.diff(F.col("dgs10"), 21), "dgs2_chg_21": t.diff(F.col("dgs2"), 21), "tnx_chg_5": t.diff(F.col("dgs10"), 5),
        }
    ]


@feature("earnings", "calendar", known_ahead=20, needs=("next_event", "is_event"))
def _earnings(t: Trail, p: Params) -> Stages:
    """Sessions to the next announcement (published ahead) and since the last one, capped."""
    before = F.max(F.when(F.col("is_event"), F.col("session_id"))).over(t.window.rowsBetween(-(1 << 30), -1))
    to = F.least(F.coalesce(F.col("next_event") - F.col("session_id"), F.lit(p.earnings_cap)), F.lit(p.earnings_cap))
    since = F.least(F.coalesce(F.col("session_id") - before, F.lit(p.since_cap)), F.lit(p.since_cap))
    return [{"days_to_earn": to, "days_since_earn": since, "earn_next": (to == 0).cast("int")}]


@feature("calendar", "calendar", needs=("month_end_id", "opex"))
def _calendar(t: Trail, p: Params) -> Stages:
    """Sessions to the month's last published session (capped at 5), and the week of its third Friday."""
    return [{"sessions_to_month_end": F.least(F.col("month_end_id") - F.col("session_id"), F.lit(5)), "opex_week": F.col("opex").cast("int")}]


def week_key(day: Column) -> Column:
    """The Friday that ends a Saturday-to-Friday week."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def third_friday(day: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "FRI"), 14)


def published_calendar(days: DataFrame, beyond: int = 45) -> DataFrame:
    """date, session_id: the sessions, and the days announced for ``beyond`` days after them."""
    last = days.agg(F.max("date").alias("d"), F.max("session_id").alias("s"))
    more = last.select(F.posexplode(F.sequence(F.date_add("d", 1), F.date_add("d", beyond))).alias("k", "date"), "s").select("date", (F.col("s") + 1 + F.col("k")).cast("long").alias("session_id"))
    return days.select("date", "session_id").unionByName(more)


def calendar_columns(days: DataFrame) -> DataFrame:
    """session_id, month_end_id, opex of every session, from the published calendar."""
    cal = published_calendar(days)
    month = F.trunc("date", "MM")
    ends = cal.groupBy(month.alias("month")).agg(F.max("session_id").alias("month_end_id"), F.max(F.when(F.col("date") <= third_friday(F.col("date")), F.col("date"))).alias("expiry"))
    weeks = ends.select(week_key(F.col("expiry")).alias("week")).distinct().withColumn("opex", F.lit(True))
    return (
        days.withColumn("month", month)
        .join(ends.select("month", "month_end_id"), "month")
        .withColumn("week", week_key(F.col("date")))
        .join(weeks, "week", "left")
        .select("session_id", "month_end_id", F.coalesce("opex", F.lit(False)).alias("opex"))
    )


def event_sessions(events: DataFrame, days: DataFrame) -> DataFrame:
    """session_id of events (date, timing): the last session up to the day, before it if announced before the open."""
    from .align import as_of

    at = F.when(F.col("timing") == "bmo", F.date_sub("date", 1)).otherwise(F.col("date"))
    found = as_of(events.select(at.alias("at")), days.select(F.col("date").alias("at"), "session_id"), "at", ["session_id"])
    return found.where("session_id is not null").select("session_id").distinct()


def event_columns(days: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, is_event, next_event: the calendar of announcements, known ahead."""
    from pyspark.sql import Window

    flagged = days.select("session_id").join(events.withColumn("is_event", F.lit(True)), "session_id", "left").withColumn("is_event", F.coalesce("is_event", F.lit(False)))
    w = Window.orderBy("session_id").rowsBetween(0, Window.unboundedFollowing)
    return flagged.withColumn("next_event", F.min(F.when(F.col("is_event"), F.col("session_id"))).over(w))


def with_context(g: DataFrame, macro: DataFrame | None = None, events: DataFrame | None = None, name: str = market.TARGET, peers: tuple[str, ...] = market.PEERS) -> DataFrame:
    """The target's rows with other tickers', macro and calendar columns; small tables, one row for each session."""
    days = g.select("session_id", "date").distinct()
    t = Trail()
    own = g.where(F.col("ticker") == name)
    funds = (("sector", market.SECTOR), ("broad", market.BROAD), ("index", market.INDEX))
    closes = g.groupBy("session_id").agg(*[F.max(F.when(F.col("ticker") == k, F.col("close"))).alias(f"{n}_close") for n, k in funds])
    moved = g.where(F.col("ticker").isin(*peers)).select("session_id", *[t.diff(ln("close"), h).alias(f"r{h}") for h in (1, 5, 21)])
    mean = moved.groupBy("session_id").agg(F.avg("r1").alias("peer_mean_1"), F.avg("r5").alias("peer_mean_5"), F.avg("r21").alias("peer_mean_21"), F.stddev_samp("r21").alias("peer_std_21"))
    own = own.join(closes, "session_id", "left").join(mean, "session_id", "left").join(calendar_columns(days), "session_id", "left")
    if macro is not None:
        own = own.join(macro, "date", "left")
    if events is not None:
        own = own.join(event_columns(days, events), "session_id", "left")
    return own


def target_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = market.grid(spark, sf_dir)
    days = g.select("session_id", "date").distinct()
    return with_context(g, market.macro(spark, sf_dir), event_sessions(market.event_days(spark, sf_dir), days))
