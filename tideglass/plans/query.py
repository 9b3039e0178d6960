"""The register of queries: a Spark plan and, where SQL can say it, the same in SQL.

Doubles are rounded alike on both sides (six decimals), because sums may be
taken in another order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[SparkSession, str], DataFrame]
    keys: tuple[str, ...]
    values: tuple[str, ...]
    body: str | None
    tables: str
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(spark, sf_dir)
        return df.select(*self.keys, *[(F.round(F.col(v).cast("double"), self.digits) + F.lit(0.0)).alias(v) for v in self.values])

    def sql(self) -> str | None:
        if self.body is None:
            return None
        head = f"{self.tables.strip()}, " if self.tables.strip() else ""
        values = "".join(f", round(CAST({v} AS DOUBLE), {self.digits}) + 0.0 AS {v}" for v in self.values)
        keys = ", ".join(self.keys)
        recursive = "RECURSIVE " if "/*recursive*/" in self.body else ""
        return f"WITH {recursive}{head}q AS ({self.body}) SELECT {keys}{values if keys else values[2:]} FROM q"


def query(name: str, keys: str = "", values: str = "", sql: str | None = None, tables: str = "", digits: int = 6):
    """Register a plan.  keys are compared as they are, values rounded."""

    def put(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = Query(name, plan, tuple(keys.split()), tuple(values.split()), sql, tables, digits)
        return plan

    return put
