"""Parsers of raw market files, as plans over lines and columns."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import keep_first, keep_last

T = TypeVar("T")


def normalize_bars(raw: DataFrame, order: list[Column], by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Lower-case names, midnight dates without zone, doubles, the last row of a repeated day."""
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if len(set(named.columns)) != len(named.columns):
        raise ValueError("columns repeat after lower-casing")
    typed = named.withColumn("date", F.to_date("date"))
    last = keep_last(typed, [*by, "date"], order)
    return last.select(*by, "date", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume") if c in named.columns])


def parse_rates(raw: DataFrame, value: str, most_bad: float = 0.001, check: bool = True) -> DataFrame:
    """date, value of a rate file: '.' and blanks are missing and go; over ``most_bad`` unreadable values raise."""
    text = F.trim(F.col(value))
    missing = text.isNull() | text.isin("", ".")
    rows = raw.withColumns({"__missing": missing, "__value": text.try_cast("double")})
    if check:
        n, bad = rows.agg(F.count(F.lit(1)), F.count_if(~F.col("__missing") & F.col("__value").isNull())).first()
        if bad > most_bad * max(n, 1):
            raise ValueError(f"{bad} of {n} values of {value} cannot be read")
    return rows.where("__value is not null").select(F.to_date("date").alias("date"), F.col("__value").alias(value))


def parse_factors(lines: DataFrame, number: str = "n", text: str = "value") -> DataFrame:
    """date and factor columns of a percent file with prose around its daily block.

    lines (n, value).  The header is the first line that begins with a comma,
    the block ends at the first line after it that has no 8-digit day.
    -99.99 and -999 are missing.
    """
    clean = lines.select(F.col(number).alias("n"), F.trim(F.col(text)).alias("t"))
    head = clean.where(F.col("t").startswith(",")).orderBy("n").first()
    if head is None:
        raise ValueError("the file has no header line")
    names = [x.strip().lower().replace("-", "_").replace(" ", "_") for x in head.t.split(",")[1:]]
    day = F.col("t").rlike(r"^\d{8}\s*,")
    stop = clean.where((F.col("n") > head.n) & ~day).agg(F.min("n")).first()[0]
    body = clean.where((F.col("n") > head.n) & day)
    if stop is not None:
        body = body.where(F.col("n") < stop)
    cells = F.split("t", ",")
    value = lambda k: F.trim(cells[k]).try_cast("double")
    known = lambda k: F.when(~value(k).isin(-99.99, -999.0), value(k) / 100)
    return body.select(F.to_date(F.trim(cells[0]), "yyyyMMdd").alias("date"), *[known(k).alias(name) for k, name in enumerate(names, 1)])


def parse_earnings(raw: DataFrame, at: str = "announced", zone: str = "America/New_York", by: tuple[str, ...] = ()) -> DataFrame:
    """date, announced, timing of UTC announcements: before noon in ``zone`` is before the open; a day's first row counts."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(at).cast("timestamp_ntz"))
    rows = raw.withColumn("announced", local).withColumn("date", F.to_date("announced"))
    return keep_first(rows, [*by, "date"], [F.col("announced")]).select(*by, "date", "announced", F.when(F.hour("announced") < 12, "bmo").otherwise("amc").alias("timing"))


def file_name(ticker: Column) -> Column:
    return F.regexp_replace(ticker, r"\^", "IDX_")


def with_retries(fetch: Callable[[], T], attempts: int = 5, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """Call until it succeeds; waits backoff * 2 ** (attempt - 1) between attempts."""
    for attempt in range(1, attempts + 1):
        try:
            return fetch()
        except Exception:
            if attempt == attempts:
                raise
            sleep(backoff * 2 ** (attempt - 1))
    raise ValueError("one attempt at least")
