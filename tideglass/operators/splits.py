"""Splitters as tables: which sample is in training or test of which split."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .align import overlap

NEVER = (1 << 62) - 1


def known_end(end: Column) -> Column:
    """A label that is not resolved ends after everything, so it is purged."""
    return F.coalesce(end, F.lit(NEVER))


def check_positions(samples: DataFrame, days: DataFrame) -> None:
    """Raise if a sample, or the end of its label, is no session."""
    bad = samples.join(days.select("session_id"), "session_id", "left_anti").count()
    bad += samples.where("t_end is not null").join(days.select(F.col("session_id").alias("t_end")), "t_end", "left_anti").count()
    if bad:
        raise ValueError(f"{bad} samples are off the session calendar")


def walk_forward(pred: DataFrame, samples: DataFrame, every: int, rolling: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """split_id, refit, session_id, role: a refit every ``every`` prediction dates; training labels end before the refit.

    pred (session_id); samples (session_id, t_end).  Blocks without training rows are dropped.
    """
    if every < 1:
        raise ValueError("a refit takes at least one prediction date")
    order = Window.orderBy("session_id")
    tests = pred.select("session_id").withColumn("split_id", F.floor((F.row_number().over(order) - 1) / every).cast("int"))
    refits = tests.groupBy("split_id").agg(F.min("session_id").alias("refit"))
    train = F.broadcast(refits).join(samples, (F.col("session_id") < F.col("refit")) & (F.col("t_end") < F.col("refit")))
    if rolling:
        train = train.withColumn("n", F.row_number().over(Window.partitionBy("split_id").orderBy(F.col("session_id").desc()))).where(F.col("n") <= rolling).drop("n")
    train = train.select("split_id", "refit", "session_id", F.lit("train").alias("role"))
    some = train.select("split_id").distinct()
    test = tests.join(refits, "split_id").join(some, "split_id", "left_semi").select("split_id", "refit", "session_id", F.lit("test").alias("role"))
    return train.unionByName(test)


def _folds(samples: DataFrame, k: int) -> DataFrame:
    """Contiguous folds of sizes that differ by one at most, the larger ones first: what ntile gives."""
    return samples.withColumn("end_", known_end(F.col("t_end"))).withColumn("fold", F.ntile(k).over(Window.orderBy("session_id")) - 1)


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold").agg(F.min("session_id").alias("first"), F.greatest(F.max("end_"), F.max("session_id")).alias("last"))


def purged_kfold(samples: DataFrame, k: int = 5, embargo: int = 0) -> DataFrame:
    """split_id, session_id, role of purged k-fold; samples (session_id, t_end).  The spans are k rows, broadcast."""
    if k < 2:
        raise ValueError("two folds at least")
    rows = _folds(samples, k)
    pairs = rows.crossJoin(F.broadcast(_spans(rows).withColumnRenamed("fold", "split_id")))
    test = F.col("fold") == F.col("split_id")
    role = F.when(test, "test").when(~overlap(F.col("session_id"), F.col("end_"), F.col("first"), F.col("last"), embargo), "train")
    return pairs.select("split_id", "session_id", role.alias("role")).where("role is not null")


def cpcv(spark: SparkSession, samples: DataFrame, groups: int = 6, tests: int = 2, embargo: int = 0) -> DataFrame:
    """split_id, session_id, role, fold: every choice of ``tests`` groups, purged around each of them."""
    if not 0 < tests < groups:
        raise ValueError("need 0 < tests < groups")
    rows = _folds(samples, groups)
    combos = [(i, g) for i, c in enumerate(itertools.combinations(range(groups), tests)) for g in c]
    chosen = spark.createDataFrame(combos, "split_id int, fold int")
    spans = chosen.join(_spans(rows), "fold").groupBy("split_id").agg(F.collect_list(F.struct("fold", "first", "last")).alias("spans"))
    pairs = rows.crossJoin(F.broadcast(spans))
    test = F.exists("spans", lambda s: s["fold"] == F.col("fold"))
    purged = F.exists("spans", lambda s: overlap(F.col("session_id"), F.col("end_"), s["first"], s["last"], embargo))
    return pairs.select("split_id", "session_id", "fold", F.when(test, "test").when(~purged, "train").alias("role")).where("role is not null")


def n_paths(groups: int, tests: int) -> int:
    return tests * math.comb(groups, tests) // groups


def cpcv_paths(groups: int, tests: int) -> list[list[tuple[int, int]]]:
    """(group, split) pairs of every path: path j takes the j-th split that tests the group."""
    of: dict[int, list[int]] = {g: [] for g in range(groups)}
    for i, combo in enumerate(itertools.combinations(range(groups), tests)):
        for g in combo:
            of[g].append(i)
    return [[(g, of[g][j]) for g in range(groups)] for j in range(n_paths(groups, tests))]
