"""Guarded windows over the session grid.

``Trail`` can only look back, ``Ahead`` only forward: features are handed a
Trail and labels an Ahead, so lookahead is excluded by construction, and the
plan lint (plans.lint) checks the result.  Lags count sessions.  A window of w
rows is null until it holds ``need`` non-null values (w unless told otherwise).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def ln(x: Column | str) -> Column:
    """Natural logarithm, null at 0 or below."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


class Trail:
    def __init__(self, *keys: str, order: str = "session_id"):
        self.window = Window.partitionBy(*(keys or ("ticker",))).orderBy(order)

    def rows(self, w: int) -> Window:
        return self.window.rowsBetween(-(w - 1), 0)

    @property
    def past(self) -> Window:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column | str, k: int = 1, default: float | None = None) -> Column:
        if k < 0:
            raise ValueError("a trail does not look ahead")
        return col(x) if k == 0 else F.lag(col(x), k, default).over(self.window)

    def diff(self, x: Column | str, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def agg(self, fn: Callable[[Column], Column], x: Column | str, w: int, need: int | None = None) -> Column:
        x = col(x)
        return F.when(F.count(x).over(self.rows(w)) >= (w if need is None else need), fn(x).over(self.rows(w)))

    def mean(self, x: Column | str, w: int, need: int | None = None) -> Column:
        return self.agg(F.avg, x, w, need)

    def std(self, x: Column | str, w: int, need: int | None = None) -> Column:
        return self.agg(F.stddev_samp, x, w, need)

    def var(self, x: Column | str, w: int, need: int | None = None) -> Column:
        return self.agg(F.var_samp, x, w, need)

    def quantile(self, x: Column | str, q: float, w: int) -> Column:
        return self.agg(lambda c: F.percentile(c, F.lit(q)), x, w)

    def pair(self, fn: Callable[[Column, Column], Column], x: Column | str, y: Column | str, w: int) -> Column:
        """A two-column statistic over rows where both are known, all w of them."""
        x, y = col(x), col(y)
        a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.when(F.count(a + b).over(self.rows(w)) >= w, fn(a, b).over(self.rows(w)))

    def fill(self, x: Column | str, limit: int | None = None) -> Column:
        """The last known value, at most ``limit`` rows old."""
        frame = self.past if limit is None else self.rows(limit + 1)
        return F.last(col(x), ignorenulls=True).over(frame)


class Ahead:
    def __init__(self, *keys: str, order: str = "session_id"):
        self.window = Window.partitionBy(*(keys or ("ticker",))).orderBy(order)

    def lead(self, x: Column | str, k: int = 1) -> Column:
        return F.lead(col(x), k).over(self.window)

    def rows(self, first: int, last: int) -> Window:
        return self.window.rowsBetween(first, last)
