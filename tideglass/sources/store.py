"""Tables on disk: per-ticker bars, feature stores, manifests, the trial registry, the lockbox.

Everything large is Parquet written and read by Spark; the small JSON files go
through Hadoop's file system too, so any store that Spark reads will do.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0].content).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def plain(x: Any) -> Any:
    """JSON's types: dates as text, numbers of other kinds as numbers, NaN as null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x


def canonical(x: Any) -> str:
    return json.dumps(plain(x), sort_keys=True, separators=(",", ":"))


def config_hash(config: Any, digits: int = 12) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()[:digits]


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(plain(value), indent=1, sort_keys=True))


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


# bars, one directory for each ticker


def write_bars(bars: DataFrame, path: str) -> DataFrame:
    """Partitioned by ticker; returns rows, first and last day of each."""
    bars.write.mode("overwrite").partitionBy("ticker").parquet(path)
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date date, open double, high double, low double, close double, volume double, ticker string").parquet(path)


def missing_from_cache(wanted: DataFrame, have: DataFrame, key: str = "ticker") -> DataFrame:
    return wanted.join(have.select(key), key, "left_anti")


# manifests


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file below: hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def data_hash(entries: DataFrame, path: str = "path", sha: str = "sha256", digits: int = 12) -> DataFrame:
    """One short hash of ``path:sha`` lines in order of path (a manifest: a row for each file)."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.concat_ws(":", path, sha).alias("line"))))
    return entries.agg(F.substring(F.sha2(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).cast("binary"), 256), 1, digits).alias("data_hash"))


def data_hash_by_range(entries: DataFrame, key: str, sha: str = "sha256", width: int = 1000, digits: int = 12) -> DataFrame:
    """One short hash of all ``key:sha`` lines: a digest for each range of ``width`` keys, then one of the digests in order.  No row gathers more than a range, or the digests."""
    line = F.struct(F.col(key).alias("k"), F.concat_ws(":", F.col(key).cast("string"), sha).alias("line"))
    joined = lambda c: F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"])).cast("binary"), 256)
    ranges = entries.groupBy(F.floor(F.col(key) / width).alias("k")).agg(joined(line).alias("line"))
    return ranges.agg(F.substring(joined(F.struct("k", "line")), 1, digits).alias("data_hash"))


def changed(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Files of the manifest that are missing or differ now."""
    j = manifest.select("path", "sha256").join(now.select("path", F.col("sha256").alias("now")), "path", "left")
    return j.where(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))


# feature store


def save_store(spark: SparkSession, path: str, features: DataFrame, labels: DataFrame, metadata: list[dict], info: dict) -> None:
    features.write.mode("overwrite").parquet(f"{path}/features")
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    write_json(spark, f"{path}/metadata.json", metadata)
    write_json(spark, f"{path}/info.json", info)


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[dict], dict]:
    for part in ("features", "labels", "metadata.json", "info.json"):
        if not exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"{path}/{part}: build the features first")
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/labels"), read_json(spark, f"{path}/metadata.json"), read_json(spark, f"{path}/info.json")


# trials


TRIAL = "seq long, kind string, name string, config string, config_hash string, data_hash string, run_id string, metrics map<string,double>, trial_id string, created_at string"


class Registry:
    """Append-only JSON lines; every fit is a row, because significance counts them.  One writer, the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], TRIAL)
        return self.spark.read.schema(TRIAL).json(self.path)

    def log(self, kind: str, name: str, config: Any, metrics: dict[str, float], run_id: str = "", data_hash: str = "") -> str:
        trial = uuid.uuid4().hex
        metrics = {k: float(v) for k, v in metrics.items() if v is not None and math.isfinite(v)}
        seq = self.rows().agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
        row = (seq, kind, name, canonical(config), config_hash(config), data_hash, run_id, metrics, trial, dt.datetime.now(dt.timezone.utc).isoformat())
        self.spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("append").json(self.path)
        return trial

    def select(self, kind: str | None = None, run_id: str | None = None) -> DataFrame:
        out = self.rows()
        if kind is not None:
            out = out.where(F.col("kind") == kind)
        return out if run_id is None else out.where(F.col("run_id") == run_id)

    def latest_run(self, kind: str) -> str | None:
        return self.select(kind).agg(F.max_by("run_id", "seq")).first()[0]


def distinct_trials(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of every kind, name and configuration."""
    w = Window.partitionBy("kind", "name", "config_hash").orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


# lockbox


class LockboxError(RuntimeError):
    """The lockbox was opened before."""


class Lockbox:
    """A sentinel file, written before anything is computed; a second opening needs force and a reason."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def check(self, force: bool = False, reason: str = "") -> None:
        if exists(self.spark, self.path) and not (force and reason.strip()):
            raise LockboxError("the lockbox was opened before: force and a reason are needed")

    def open(self, force: bool = False, reason: str = "") -> dict:
        self.check(force, reason)
        past = read_json(self.spark, self.path)["openings"] if exists(self.spark, self.path) else []
        now = {"opened_at": dt.datetime.now(dt.timezone.utc).isoformat(), "reason": reason, "completed_at": None}
        write_json(self.spark, self.path, {"openings": [*past, now]})
        return now

    def complete(self) -> None:
        state = read_json(self.spark, self.path)
        state["openings"][-1]["completed_at"] = dt.datetime.now(dt.timezone.utc).isoformat()
        write_json(self.spark, self.path, state)
