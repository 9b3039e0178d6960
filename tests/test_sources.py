"""Parsers on inline text, stores, the pipeline end to end, streaming."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tideglass.__main__ import main
from tideglass.operators import align
from tideglass.plans import config
from tideglass.plans.research import Research, inject
from tideglass.sources import market, parsers, store
from tideglass.streaming import bars as stream


def test_rates(spark):
    rows = [("2020-01-02", "1.88"), ("2020-01-03", "."), ("2020-01-06", ""), ("2020-01-07", "1.81")]
    got = parsers.parse_rates(spark.createDataFrame(rows, "date string, DGS10 string"), "DGS10").orderBy("date").collect()
    assert [r.DGS10 for r in got] == [1.88, 1.81]
    with pytest.raises(ValueError):
        parsers.parse_rates(spark.createDataFrame([("2020-01-02", "4.1%")] * 28, "date string, DGS10 string"), "DGS10")


def test_factors(spark):
    text = ["This file was made", "", ",Mkt-RF,SMB,RF", "20200102,  0.86,-0.97,0.006", "20200103,-0.67,-99.99,0.006", "", " Annual", "2020,1,2,3"]
    got = parsers.parse_factors(spark.createDataFrame(list(enumerate(text)), "n long, value string")).orderBy("date").collect()
    assert len(got) == 2 and got[0].mkt_rf == pytest.approx(0.0086) and got[1].smb is None and got[0].date == dt.date(2020, 1, 2)


def test_earnings(spark):
    rows = [("2024-05-22 20:20:00",), ("2024-05-24 12:00:00",), ("2024-08-28 19:00:00",), ("2024-08-28 22:00:00",)]
    raw = spark.createDataFrame(rows, "s string").select(F.expr("cast(s as timestamp_ntz)").alias("announced"))
    got = parsers.parse_earnings(raw).orderBy("date").collect()
    assert [(r.date.isoformat(), r.timing) for r in got] == [("2024-05-22", "amc"), ("2024-05-24", "bmo"), ("2024-08-28", "amc")]


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "got"

    assert parsers.with_retries(flaky, 5, 2.0, waits.append) == "got" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        parsers.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, 0, waits.append)


def test_as_of(spark):
    right = spark.createDataFrame([(10, "a"), (20, "b")], "at int, v string")
    left = spark.createDataFrame([(5,), (10,), (15,), (25,)], "at int")
    got = lambda **k: [r.v for r in align.as_of(left, right, "at", ["v"], **k).orderBy("at").collect()]
    assert got() == [None, "a", "a", "b"]
    assert got(strict=True) == [None, None, "a", "b"]
    assert got(after=True) == ["a", "a", "b", None]
    assert got(after=True, strict=True) == ["a", "b", "b", None]


def test_fill_limit(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    days = spark.createDataFrame([(day(i),) for i in range(0, 12)], "date date")
    src = spark.createDataFrame([(day(0), 1.0)], "date date, v double")
    got = [r.v for r in align.fill_forward(src, days, ["v"], 5).orderBy("date").collect()]
    assert got == [1.0] * 6 + [None] * 6


def test_store_and_registry(spark, tmp_path):
    base = str(tmp_path)
    b = market.bars(spark, "/root/testdata/sf0.001")
    store.write_bars(b, f"{base}/bars")
    assert store.read_bars(spark, f"{base}/bars").count() == b.count()
    now = store.file_hashes(spark, f"{base}/bars").cache()
    one = store.data_hash(now).first().data_hash
    assert len(one) == 12 and one == store.data_hash(now.repartition(3)).first().data_hash
    assert store.changed(now, now).count() == 0
    assert store.changed(now, now.limit(0)).first().state == "missing"
    r = store.Registry(spark, f"{base}/trials")
    assert r.rows().count() == 0 and r.latest_run("model") is None
    for run, alpha in (("r1", 1), ("r1", 1), ("r2", 2)):
        r.log("model", "ridge", {"alpha": alpha}, {"ic": 0.1, "bad": float("nan")}, run)
    assert r.latest_run("model") == "r2" and store.distinct_trials(r.rows()).count() == 2 and r.select("model", "r1").count() == 2
    assert store.config_hash({"a": 1, "b": 2}) == store.config_hash({"b": 2, "a": 1})
    box = store.Lockbox(spark, f"{base}/lock.json")
    box.open()
    with pytest.raises(store.LockboxError):
        box.open()
    with pytest.raises(store.LockboxError):
        box.open(force=True)
    box.open(force=True, reason="a bug in costs")
    box.complete()
    assert len(store.read_json(spark, f"{base}/lock.json")["openings"]) == 2
    with pytest.raises(FileNotFoundError):
        store.load_store(spark, f"{base}/none")


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("seed: 1\ncv: {embargo: 7, folds: 3}\n")
    (tmp_path / "fast.yaml").write_text("extends: base.yaml\ncv: {folds: 4}\nmodels: [ridge]\n")
    c = config.load(str(tmp_path / "fast.yaml"))
    assert (c.seed, c.cv.embargo, c.cv.folds, c.models) == (1, 7, 4, ("ridge",))
    with pytest.raises(KeyError):
        config.load(sede=3)
    with pytest.raises(ValueError):
        config.load(cv={"embargo": -1})
    assert inject("a <!-- x:begin -->old<!-- x:end --> b", "x", "new") == "a <!-- x:begin -->\nnew\n<!-- x:end --> b"


def test_pipeline_end_to_end(spark, tmp_path):
    cfg = config.load(work_dir=str(tmp_path), sessions=1100, signal=0.4, models=["hist_mean", "ridge"], cv={"initial_train": 500, "retrain_every": 126}, evaluation={"reps": 50, "pbo_blocks": 6})
    r = Research(spark, cfg)
    r.run("reproduce")
    result = store.read_json(spark, r.path("results.json"))
    ev = result["evaluation"]
    assert ev["last_session"] < cfg.lockbox_start and ev["trials"] == 12
    assert {i["model"]: i["ic"] for i in ev["information"]}["ridge"] > 0.05
    assert "| strategy |" in store.read_text(spark, r.path("RESULTS.md"))
    locked = r.run("lockbox")
    assert locked["last_session"] >= cfg.lockbox_start
    with pytest.raises(store.LockboxError):
        r.run("lockbox")


def test_command_line(spark, capsys):
    assert main(["info"]) == 0
    assert json.loads(capsys.readouterr().out)["seed"] == 42


def streamed(spark, df, make, name, mode, tmp_path):
    q = make(df).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, make in (("hourly", stream.hourly_bars), ("sliding", stream.sliding_bars), ("visits", stream.sessions)):
        got = streamed(spark, live, make, name, "complete", tmp_path)
        tidy = lambda d: sorted(map(str, d.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in d.dtypes]).collect()))
        assert tidy(got) == tidy(make(events))
    late = streamed(spark, live, lambda d: stream.hourly_bars(d, "1 hour"), "late", "append", tmp_path)
    assert 0 < late.count() <= stream.hourly_bars(events).count()


def test_as_of_by_slots(spark):
    """One hot key and others, cut in slots, strict or not, forward or backward, against a search in sorted lists."""
    rng = random.Random(9)
    left = [(rng.choice("aaab"), at) for at in rng.sample(range(400), 120)] + [("none", 5)]
    right = [(rng.choice("aaab"), at, at * 10) for at in rng.sample(range(400), 60)]
    table = (spark.createDataFrame(left, "k string, at int"), spark.createDataFrame(right, "k string, at int, v int"))
    for strict in (False, True):
        for after in (False, True):
            got = align.as_of(*table, "at", ["v"], ("k",), strict, after, slot=lambda t: F.floor(t / 7))
            assert got.columns == ["k", "at", "v"]

            def near(k, at):
                found = [r for c, r, _ in right if c == k and ((r > at if after else r < at) or (r == at and not strict))]
                return (min(found) if after else max(found)) * 10 if found else None

            assert sorted((r.k, r.at, r.v or -1) for r in got.collect()) == sorted((k, at, near(k, at) or -1) for k, at in left)
