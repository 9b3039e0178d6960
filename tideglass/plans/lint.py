"""Causality lint: no registered feature may look ahead, whatever its code does.

All specs are built over an empty frame and the analysed plan is read: a lead,
or a window frame that ends after the current row, is a finding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators import features as X

BASE = "ticker string, session_id long, date date, open double, high double, low double, close double, volume double"
CONTEXT = (
    "sector_close double, broad_close double, index_close double, peer_mean_1 double, peer_mean_5 double, peer_mean_21 double, peer_std_21 double, "
    "vix double, vix3m double, dgs10 double, dgs2 double, is_event boolean, next_event long, month_end_id long, opex boolean"
)
AHEAD = re.compile(r"\blead\(|specifiedwindowframe\(\w+, (?:-?\d+|\w+\$\(\)), (?:unboundedfollowing|[1-9])", re.IGNORECASE)


def looks_ahead(df: DataFrame) -> list[str]:
    """Window expressions of the analysed plan that read later rows."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return sorted({plan[max(0, m.start() - 60) : m.end() + 40].replace("\n", " ") for m in AHEAD.finditer(plan)})


def lint_features(spark: SparkSession, p: X.Params = X.Params()) -> dict[str, list[str]]:
    """spec -> findings, for those that have any."""
    frame = spark.createDataFrame([], f"{BASE}, {CONTEXT}")
    found = {name: looks_ahead(X.build(frame, [name], p)) for name in X.SPECS}
    return {k: v for k, v in found.items() if v}
