"""Queries of sources, filters, joins, set operations and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import Trail, ln
from ..operators import align as A
from ..operators import quality as Q
from ..sources import market as M
from ..sources import parsers, store
from .feature_queries import GRID, RANGES, guard, lag
from .query import query

BARS = M.BARS_SQL
OHLCV = "open high low close volume"
query("s12_bars", "ticker date", OHLCV, digits=9, sql="SELECT * FROM bars", tables=BARS)(M.bars)
query("j01_calendar_align", "ticker session_id date", OHLCV, digits=9, sql="SELECT * FROM grid", tables=GRID)(M.grid)


@query("s02_normalize", "ticker date", "close volume", digits=9, sql="SELECT flag AS ticker, date, arg_max(price, seq) AS close, arg_max(qty, seq) AS volume FROM trades GROUP BY flag, date", tables=M.TRADES_SQL)
def _normalize(spark, sf):
    raw = M.trades(spark, sf).select(F.col("flag").alias("Ticker"), F.col("date").alias("DATE"), F.col("price").alias("Close"), F.col("qty").alias("Volume"), "seq")
    return parsers.normalize_bars(raw, [F.col("seq")])


@query("s03_parse_rates", "date n", "rate", sql="SELECT date, count(*) AS n, avg(l_tax * 100) AS rate FROM trades WHERE l_tax > 0 GROUP BY date", tables=M.TRADES_SQL)
def _rates(spark, sf):
    raw = M.trades(spark, sf).select("date", F.when(F.col("l_tax") > 0, (F.col("l_tax") * 100).cast("string")).otherwise(".").alias("rate"))
    return parsers.parse_rates(raw, "rate").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("rate").alias("rate"))


@query("s05_parse_factors", "date", "mkt_rf mom", sql="SELECT date, round(dgs10, 4) / 100 AS mkt_rf, CASE WHEN dgs2 > 4 THEN round(dgs2, 4) / 100 END AS mom FROM macro", tables=f"{BARS}, {M.MACRO_SQL}")
def _factors(spark, sf):
    """The trades' daily means written as a percent file with prose around it, and read back."""
    daily = M.macro(spark, sf).select("date", F.concat_ws(",", F.date_format("date", "yyyyMMdd"), F.format_string("%.4f", "dgs10"), F.when(F.col("dgs2") > 4, F.format_string("%.4f", "dgs2")).otherwise("-99.99")).alias("value"))
    n = (F.row_number().over(Window.orderBy("date")) + 2).cast("long")
    lines = daily.select(n.alias("n"), "value").unionByName(spark.createDataFrame([(0, "Daily factors, in percent"), (1, ""), (2, ",Mkt-RF,Mom"), (10**9, "Annual factors"), (10**9 + 1, "19950101,9,9")], "n long, value string"))
    return parsers.parse_factors(lines)


@query("s07_parse_earnings", "event_type date timing", sql="SELECT event_type, date, CASE WHEN hour(local) < 12 THEN 'bmo' ELSE 'amc' END AS timing FROM (SELECT event_type, CAST(ts - INTERVAL 5 HOUR AS DATE) AS date, min(ts - INTERVAL 5 HOUR) AS local FROM events GROUP BY 1, 2)")
def _earnings(spark, sf):
    return parsers.parse_earnings(M.table(spark, sf, "events"), "ts", by=("event_type",))


@query("s10_cache_fill", "ticker date", sql="SELECT t.ticker, s.date FROM sessions s CROSS JOIN (SELECT DISTINCT ticker FROM bars) t WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = t.ticker AND b.date = s.date)", tables=BARS)
def _cache_fill(spark, sf):
    b = M.bars(spark, sf)
    wanted = b.select("ticker").distinct().crossJoin(F.broadcast(M.sessions(b).select("date")))
    return wanted.join(b.select("ticker", "date"), ["ticker", "date"], "left_anti")


@query("s15_json_scan", "event_type n", "score", sql="SELECT event_type, count(*) AS n, sum(length(props)) AS score FROM events GROUP BY event_type")
def _json(spark, sf):
    return M.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).alias("score"))


_LINES = "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) || ':' || sha256(o_orderstatus || CAST(o_custkey AS VARCHAR)) AS line FROM orders"


@query("k03_data_hash_all", "data_hash", sql=f"SELECT substr(sha256(string_agg(line, chr(10) ORDER BY part)), 1, 12) AS data_hash FROM (SELECT k // 1000 AS part, sha256(string_agg(line, chr(10) ORDER BY k)) AS line FROM ({_LINES}) GROUP BY 1)")
def _data_hash_all(spark, sf):
    """The manifest's hash over every order, in two levels of key ranges."""
    o = M.table(spark, sf, "orders")
    return store.data_hash_by_range(o.select("o_orderkey", F.sha2(F.concat("o_orderstatus", F.col("o_custkey").cast("string")).cast("binary"), 256).alias("sha256")), "o_orderkey")


query("k01_manifest_stats", "ticker rows first last", sql="SELECT ticker, count(*) AS rows, min(date) AS first, max(date) AS last FROM bars GROUP BY ticker", tables=BARS)(lambda s, d: M.bars(s, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last")))
CUT, BEGIN = "1998-06-30", "2000-01-01"
query("p01_truncate", "ticker date", "close", digits=9, sql=f"SELECT ticker, date, close FROM bars WHERE date <= DATE '{CUT}'", tables=BARS)(lambda s, d: M.bars(s, d).where(F.col("date") <= F.to_date(F.lit(CUT))))
query("p02_slice_from", "ticker date", "close", digits=9, sql=f"SELECT ticker, date, close FROM bars WHERE date >= DATE '{BEGIN}'", tables=BARS)(lambda s, d: M.bars(s, d).where(F.col("date") >= F.to_date(F.lit(BEGIN))))
query("p05_dev_split", "part n last", sql=f"SELECT CASE WHEN date < DATE '{BEGIN}' THEN 'dev' ELSE 'lockbox' END AS part, count(*) AS n, max(date) AS last FROM sessions GROUP BY 1", tables=BARS)(lambda s, d: M.sessions(M.bars(s, d)).groupBy(F.when(F.col("date") < F.to_date(F.lit(BEGIN)), "dev").otherwise("lockbox").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")))
query("p06_first_last_valid", "ticker first last", sql="SELECT ticker, min(date) FILTER (close IS NOT NULL) AS first, max(date) FILTER (close IS NOT NULL) AS last FROM grid GROUP BY ticker", tables=GRID)(lambda s, d: M.grid(s, d).groupBy("ticker").agg(*[f(F.when(F.col("close").isNotNull(), F.col("date"))).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]))
query("p07_modelling_start", "start", sql="SELECT max(first) AS start FROM (SELECT ticker, min(date) AS first FROM bars GROUP BY ticker)", tables=BARS)(lambda s, d: M.bars(s, d).groupBy("ticker").agg(F.min("date").alias("first")).agg(F.max("first").alias("start")))
query("p08_complete_rows", "ticker session_id", "r y", sql=f"SELECT ticker, session_id, r, y FROM (SELECT ticker, session_id, r, ln(lead(open, 2) OVER (PARTITION BY ticker ORDER BY session_id)) - ln(lead(open) OVER (PARTITION BY ticker ORDER BY session_id)) AS y, {lag('close', 63)} AS old FROM ranges) WHERE r IS NOT NULL AND y IS NOT NULL AND old IS NOT NULL", tables=RANGES)(
    lambda s, d: (lambda t: M.grid(s, d).withColumns({"r": t.diff(ln("close")), "y": F.lead(ln("open"), 2).over(t.window) - F.lead(ln("open")).over(t.window), "old": t.lag("close", 63)}).na.drop(subset=["r", "y", "old"]))(Trail())
)
query("p09_file_names", "name n", sql="SELECT regexp_replace('^' || event_type, '\\^', 'IDX_', 'g') AS name, count(*) AS n FROM events GROUP BY 1")(lambda s, d: M.table(s, d, "events").groupBy(parsers.file_name(F.concat(F.lit("^"), "event_type")).alias("name")).agg(F.count(F.lit(1)).alias("n")))
query("p11_assign", "ticker session_id primary_side", sql=f"SELECT ticker, session_id, CASE WHEN close > {guard('avg({})', 'close', 20)} THEN 1 ELSE 0 END AS primary_side FROM grid", tables=GRID)(lambda s, d: M.grid(s, d).withColumn("primary_side", F.when(F.col("close") > Trail().mean("close", 20), 1).otherwise(0)))
query("p12_fill", "ticker session_id", "z", sql="SELECT ticker, session_id, coalesce((r - avg(r) OVER (PARTITION BY ticker)) / stddev_pop(r) OVER (PARTITION BY ticker), 0) AS z FROM ranges", tables=RANGES)(
    lambda s, d: (lambda t, w: M.grid(s, d).withColumn("r", t.diff(ln("close"))).withColumn("z", F.coalesce((F.col("r") - F.avg("r").over(w)) / F.stddev_pop("r").over(w), F.lit(0.0))))(Trail(), Window.partitionBy("ticker"))
)
query("p13_clip", "ticker session_id", "c", sql="SELECT ticker, session_id, CASE WHEN r IS NOT NULL THEN least(greatest(r, -1), 1.5) END AS c FROM ranges", tables=RANGES)(lambda s, d: (lambda t: M.grid(s, d).withColumn("r", t.diff(ln("close"))).withColumn("c", F.when(F.col("r").isNotNull(), F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.5)))))(Trail()))
query("p14_melt", "ticker session_id field", "value", digits=9, sql="SELECT ticker, session_id, field, value FROM (UNPIVOT (SELECT ticker, session_id, open, close FROM grid) ON open, close INTO NAME field VALUE value)", tables=GRID)(lambda s, d: M.grid(s, d).unpivot(["ticker", "session_id"], ["open", "close"], "field", "value").where("value is not null"))
query("p15_target_rows", "session_id", "close", digits=9, sql="SELECT session_id, close FROM grid WHERE ticker = 'ALL'", tables=GRID)(M.target)


@query("p04_perturb", "ticker changed n", sql="SELECT ticker, session_id > 1000 AND close IS NOT NULL AS changed, count(*) AS n FROM grid GROUP BY 1, 2", tables=GRID)
def _perturb(spark, sf):
    """Values after a cut are multiplied by lognormal noise; those before it stay."""
    g = M.grid(spark, sf)
    p = g.withColumn("new", F.when(F.col("session_id") > 1000, F.col("close") * F.exp(0.5 * F.randn(7))).otherwise(F.col("close")))
    return p.groupBy("ticker", (~F.col("new").eqNullSafe(F.col("close"))).alias("changed")).agg(F.count(F.lit(1)).alias("n"))


TWO = f"{BARS}, a AS (SELECT date, close AS ca FROM bars WHERE ticker = 'A'), n AS (SELECT date, close AS cn FROM bars WHERE ticker = 'N')"


def _pair(spark, sf, how):
    b = M.bars(spark, sf)
    return b.where("ticker = 'A'").select("date", F.col("close").alias("ca")).join(b.where("ticker = 'N'").select("date", F.col("close").alias("cn")), "date", how)


query("j02_full_outer", "date", "ca cn", digits=9, sql="SELECT date, ca, cn FROM a FULL OUTER JOIN n USING (date)", tables=TWO)(lambda s, d: _pair(s, d, "full_outer"))
query("j03_inner_align", "date", "ca cn", digits=9, sql="SELECT date, ca, cn FROM a JOIN n USING (date)", tables=TWO)(lambda s, d: _pair(s, d, "inner").na.drop())
query("j05_semi", "date timing", sql="SELECT date, timing FROM event_days WHERE date IN (SELECT date FROM sessions)", tables=f"{BARS}, {M.EVENTS_SQL}")(lambda s, d: M.event_days(s, d).join(M.bars(s, d).select("date"), "date", "left_semi"))
query("j06_anti", "date timing", sql="SELECT date, timing FROM event_days WHERE date NOT IN (SELECT date FROM sessions)", tables=f"{BARS}, {M.EVENTS_SQL}")(lambda s, d: M.event_days(s, d).join(M.bars(s, d).select("date"), "date", "left_anti"))
query("j07_as_of", "date timing session_id", sql="SELECT e.date, e.timing, s.session_id FROM (SELECT *, CASE WHEN timing = 'bmo' THEN date - 1 ELSE date END AS at FROM event_days) e ASOF LEFT JOIN sessions s ON s.date <= e.at", tables=f"{BARS}, {M.EVENTS_SQL}")(
    lambda s, d: A.as_of(M.event_days(s, d).withColumn("at", F.when(F.col("timing") == "bmo", F.date_sub("date", 1)).otherwise(F.col("date"))), M.sessions(M.bars(s, d)).withColumnRenamed("date", "at"), "at", ["session_id"])
)
query("j07b_as_of_by_key", "event_id event_type prior", sql="SELECT e.event_id, e.event_type, p.event_id AS prior FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE value > 50) p ON p.event_type = e.event_type AND p.ts < e.ts")(
    lambda s, d: (lambda e: A.as_of(e.select("event_id", "event_type", "ts"), e.where("value > 50").select("event_type", "ts", F.col("event_id").alias("prior")), "ts", ["prior"], ("event_type",), strict=True, slot=lambda t: F.date_trunc("hour", t)))(M.table(s, d, "events"))
)
_FILL = "last_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query("j08_fill_forward", "date", "v", sql=f"SELECT date, v FROM (SELECT date, s, {_FILL} AS v FROM (SELECT coalesce(m.date, s.date) AS date, s.date AS s, m.v FROM (SELECT date, dgs10 AS v FROM macro WHERE day(date) <= 3) m FULL OUTER JOIN sessions s ON s.date = m.date)) WHERE s IS NOT NULL", tables=f"{BARS}, {M.MACRO_SQL}")
def _fill(spark, sf):
    source = M.macro(spark, sf).where(F.dayofmonth("date") <= 3).select("date", F.col("dgs10").alias("v"))
    return A.fill_forward(source, M.sessions(M.bars(spark, sf)), ["v"], 5)


_EV = f"{BARS}, {M.EVENTS_SQL}, fl AS (SELECT s.session_id, e.d IS NOT NULL AS is_event FROM sessions s LEFT JOIN (SELECT DISTINCT date AS d FROM event_days) e ON e.d = s.date)"


def _flagged(spark, sf):
    return M.sessions(M.bars(spark, sf)).join(M.event_days(spark, sf).select("date").distinct().withColumn("is_event", F.lit(True)), "date", "left").withColumn("is_event", F.coalesce("is_event", F.lit(False)))


query("j09_next_event", "session_id to_next", sql="SELECT session_id, least(coalesce(min(CASE WHEN is_event THEN session_id END) OVER (ORDER BY session_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - session_id, 20), 20) AS to_next FROM fl", tables=_EV)(
    lambda s, d: _flagged(s, d).withColumn("to_next", F.least(F.coalesce(F.min(F.when(F.col("is_event"), F.col("session_id"))).over(Window.orderBy("session_id").rowsBetween(0, Window.unboundedFollowing)) - F.col("session_id"), F.lit(20)), F.lit(20)))
)
query("j10_last_event", "session_id since", sql="SELECT session_id, least(coalesce(session_id - max(CASE WHEN is_event THEN session_id END) OVER (ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 63), 63) AS since FROM fl", tables=_EV)(
    lambda s, d: _flagged(s, d).withColumn("since", F.least(F.coalesce(F.col("session_id") - F.max(F.when(F.col("is_event"), F.col("session_id"))).over(Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(63)), F.lit(63)))
)
query("j17_lookup", "ticker session_id", "prev_open", digits=9, sql="SELECT g.ticker, g.session_id, p.open AS prev_open FROM grid g LEFT JOIN grid p ON p.ticker = g.ticker AND p.session_id = g.session_id - 1", tables=GRID)(
    lambda s, d: (lambda g: g.select("ticker", "session_id").join(g.select("ticker", (F.col("session_id") + 1).alias("session_id"), F.col("open").alias("prev_open")), ["ticker", "session_id"], "left"))(M.grid(s, d))
)
query("r26_data_quality", "ticker first last expected missing run outliers", sql="SELECT b.ticker, b.first, b.last, b.expected, b.missing, r.run, coalesce(o.outliers, 0) AS outliers FROM base b JOIN longest r USING (ticker) LEFT JOIN flagged o USING (ticker)", tables=f"""{GRID},
live AS (SELECT *, ln(close) - ln({lag('close')}) AS r FROM grid g WHERE session_id BETWEEN (SELECT min(session_id) FROM grid x WHERE x.ticker = g.ticker AND x.close IS NOT NULL) AND (SELECT max(session_id) FROM grid x WHERE x.ticker = g.ticker AND x.close IS NOT NULL)),
base AS (SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS expected, count(*) FILTER (close IS NULL) AS missing FROM live GROUP BY ticker),
known AS (SELECT ticker, session_id, CASE WHEN close = {lag('close')} THEN 0 ELSE 1 END AS c FROM live WHERE close IS NOT NULL),
islands AS (SELECT ticker, sum(c) OVER (PARTITION BY ticker ORDER BY session_id) AS i FROM known),
longest AS (SELECT ticker, max(n) AS run FROM (SELECT ticker, i, count(*) AS n FROM islands GROUP BY 1, 2) GROUP BY ticker),
med AS (SELECT ticker, quantile_cont(r, 0.5) AS med FROM live GROUP BY ticker),
mad AS (SELECT l.ticker, any_value(m.med) AS med, quantile_cont(abs(l.r - m.med), 0.5) * 1.4826 AS mad FROM live l JOIN med m USING (ticker) GROUP BY l.ticker),
flagged AS (SELECT l.ticker, count(*) AS outliers FROM live l JOIN mad m USING (ticker) WHERE m.mad > 0 AND abs(l.r - m.med) > 10 * m.mad GROUP BY l.ticker)""")(lambda s, d: Q.ticker_quality(M.grid(s, d)))
query("w23_stale_run", "event_type run", sql="SELECT event_type, max(n) AS run FROM (SELECT event_type, i, count(*) AS n FROM (SELECT event_type, sum(c) OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM (SELECT event_type, event_id, CASE WHEN floor(value / 50) = lag(floor(value / 50)) OVER (PARTITION BY event_type ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events WHERE value IS NOT NULL)) GROUP BY 1, 2) GROUP BY event_type")(
    lambda s, d: Q.stale_runs(M.table(s, d, "events").select("event_type", F.col("event_id").alias("session_id"), F.floor(F.col("value") / 50).alias("v")), "v", ("event_type",))
)
_SPLIT = "1998-03-02"
query("r27_split_check", "ticker passed", "close_ratio open_ratio volume_ratio", sql="SELECT ticker, coalesce(abs(ln(cr)) < ln(4) / 2 AND abs(ln(orr)) < ln(4) / 2 AND abs(ln(vr)) < ln(4) / 2, false) AS passed, cr AS close_ratio, orr AS open_ratio, vr AS volume_ratio FROM (SELECT b.ticker, a.c1 / b.c0 AS cr, a.o1 / b.c0 AS orr, a.v1 / b.v0 AS vr FROM (SELECT ticker, max(CASE WHEN k = 1 THEN close END) AS c0, quantile_cont(volume, 0.5) AS v0 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM grid WHERE date < DATE '1998-03-02') WHERE k <= 20 GROUP BY ticker) b JOIN (SELECT ticker, max(CASE WHEN k = 1 THEN close END) AS c1, max(CASE WHEN k = 1 THEN open END) AS o1, quantile_cont(volume, 0.5) AS v1 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM grid WHERE date >= DATE '1998-03-02') WHERE k <= 20 GROUP BY ticker) a USING (ticker))", tables=GRID)(
    lambda s, d: Q.split_check(M.grid(s, d), _SPLIT, 4.0)
)
_NEAR = " OR ".join(f"abs(-r - ln({f})) < 0.05" for f in Q.SPLIT_FACTORS)
query("r28_suspect_splits", "ticker session_id", "r", sql=f"SELECT ticker, session_id, r FROM (SELECT ticker, session_id, r, quantile_cont(volume, 0.5) OVER (PARTITION BY ticker ORDER BY session_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vb, quantile_cont(volume, 0.5) OVER (PARTITION BY ticker ORDER BY session_id ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS va FROM ranges) WHERE abs(r) > ln(1.8) AND ({_NEAR}) AND vb > 0 AND abs(ln(va / vb) + r) < ln(1.5)", tables=RANGES)(lambda s, d: Q.suspect_splits(M.grid(s, d)))
query("r29_schema_violations", "ticker rows bad_open bad_volume crossed repeated", sql="SELECT ticker, count(*) AS rows, count(*) FILTER (open <= 0) AS bad_open, count(*) FILTER (volume < 0) AS bad_volume, count(*) FILTER (high < low) AS crossed, count(date) - count(DISTINCT date) AS repeated FROM bars GROUP BY ticker", tables=BARS)(lambda s, d: Q.violations(M.bars(s, d)))
query("r30_trial_dedupe", "kind name config_hash seq", sql="SELECT o_orderstatus AS kind, o_orderpriority AS name, CAST(o_custkey % 10 AS VARCHAR) AS config_hash, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2, 3")(
    lambda s, d: store.distinct_trials(M.table(s, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 10).cast("string").alias("config_hash"), F.col("o_orderkey").alias("seq")))
)
query("r31_latest_run", "kind run_id", sql="SELECT o_orderstatus AS kind, arg_max(o_custkey, o_orderkey) AS run_id FROM orders GROUP BY 1")(lambda s, d: M.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.max_by("o_custkey", "o_orderkey").alias("run_id")))
query("o02_top_k", "ticker session_id", "move", sql="SELECT ticker, session_id, m AS move FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(m, 9) DESC, session_id) AS k FROM (SELECT *, abs(r) AS m FROM ranges WHERE r IS NOT NULL)) WHERE k <= 20", tables=RANGES)(
    lambda s, d: (lambda t: M.grid(s, d).withColumn("move", F.abs(t.diff(ln("close")))).where("move is not null").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.round("move", 9).desc(), "session_id"))).where("k <= 20"))(Trail())
)
query("o01_sorted_all", "position ticker session_id", sql="SELECT row_number() OVER (ORDER BY date, ticker) AS position, ticker, session_id FROM grid", tables=GRID)(lambda s, d: positions(M.grid(s, d)))
query("o03_arg_max", "ticker date", sql="SELECT ticker, min(date) AS date FROM bars b WHERE volume = (SELECT max(volume) FROM bars x WHERE x.ticker = b.ticker) GROUP BY ticker", tables=BARS)(lambda s, d: M.bars(s, d).groupBy("ticker").agg(F.min_by("date", F.struct(-F.col("volume"), F.col("date"))).alias("date")))
query("o04_union_calendars", "date", sql="SELECT date FROM sessions UNION SELECT date FROM event_days", tables=f"{BARS}, {M.EVENTS_SQL}")(lambda s, d: M.bars(s, d).select("date").union(M.event_days(s, d).select("date")).distinct())
query("o05_union_all_whole", "ticker session_id", sql="SELECT ticker, session_id FROM grid UNION ALL SELECT ticker, session_id FROM grid", tables=GRID)(lambda s, d: M.grid(s, d).unionByName(M.grid(s, d)))
query("o06_intersect", "date", sql="SELECT date FROM bars WHERE ticker = 'A' INTERSECT SELECT date FROM bars WHERE ticker = 'R'", tables=BARS)(lambda s, d: (lambda b: b.where("ticker = 'A'").select("date").intersect(b.where("ticker = 'R'").select("date")))(M.bars(s, d)))
query("o07_except", "date", sql="SELECT date FROM sessions EXCEPT SELECT date FROM event_days", tables=f"{BARS}, {M.EVENTS_SQL}")(lambda s, d: M.bars(s, d).select("date").subtract(M.event_days(s, d).select("date")))
query("o08_keep_first_last", "o_custkey first last", sql="SELECT o_custkey, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey")(
    lambda s, d: (lambda o, by: A.keep_first(o, ["o_custkey"], by).select("o_custkey", F.col("o_orderkey").alias("first")).join(A.keep_last(o, ["o_custkey"], by).select("o_custkey", F.col("o_orderkey").alias("last")), "o_custkey"))(M.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")])
)
query("o09_every_kth", "ticker session_id", sql="SELECT ticker, session_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session_id) AS k FROM grid WHERE close IS NOT NULL) WHERE (k - 1) % 21 = 0", tables=GRID)(lambda s, d: M.grid(s, d).where("close is not null").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("session_id"))).where("(k - 1) % 21 = 0"))
query("st01_hourly_bars", "event_type hour n", OHLCV, digits=9, sql="SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume FROM events GROUP BY 1, 2")(
    lambda s, d: hourly(M.table(s, d, "events"))
)


def positions(grid):
    """Row numbers in order of date and ticker: the rows of earlier dates (the calendar bounds them), and the rank within the date."""
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    earlier = grid.groupBy("date").agg(F.count(F.lit(1)).alias("n")).select("date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return grid.join(F.broadcast(earlier), "date").withColumn("position", F.col("earlier") + F.row_number().over(Window.partitionBy("date").orderBy("ticker")))


def hourly(events):
    from ..streaming.bars import hourly_bars

    return hourly_bars(events).select("event_type", F.col("hour"), "n", "open", "high", "low", "close", "volume")


_SIX = "SELECT event_type, ts, value, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start FROM events, range(0, 6) t(k)"


@query("st02_sliding_bars", "event_type start n", OHLCV, digits=9, sql=f"SELECT event_type, start, count(*) AS n, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume FROM ({_SIX}) GROUP BY 1, 2")
def _sliding(spark, sf):
    from ..streaming.bars import sliding_bars

    return sliding_bars(M.table(spark, sf, "events"))


@query("st03_user_sessions", "user_id start n", "value", sql="SELECT user_id, min(ts) AS start, count(*) AS n, sum(value) AS value FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, i")
def _visits(spark, sf):
    from ..streaming.bars import sessions

    return sessions(M.table(spark, sf, "events"))
