"""Column expressions that Spark has no single function for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def truncated(day: Column, step: str) -> Column:
    """The first day of the step that holds ``day``; weeks begin on Mondays."""
    return F.date_trunc(step, day).cast("date")


def steps_between(first: Column, last: Column, step: str) -> Column:
    return F.sequence(first, last, F.expr(INTERVALS[step]))


def step_index(day: Column, step: str) -> Column:
    """Whole steps since a fixed origin, so that differences count steps; weeks are counted from a Monday."""
    if step == "day":
        return F.unix_date(day).cast("long")
    if step == "week":
        return F.floor((F.unix_date(day) - 4) / 7)
    months = F.year(day) * 12 + F.month(day) - 1
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[step])


def series_key(dims: list[str], null_token: str | None = None) -> Column:
    """Dimension values joined by bars. Nulls are left out unless a token stands for them."""
    if not dims:
        return F.lit("all")
    return F.concat_ws("|", *[F.coalesce(F.col(d), F.lit(null_token)) if null_token is not None else F.col(d) for d in dims])


def known(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def upper_median(name: str) -> Column:
    """Aggregate: the element at half the count of the sorted values, the larger of two middles."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def calendar(day: Column) -> dict[str, Column]:
    """Week by day of the year, month, quarter, and weekday with Monday 0."""
    return {"week": (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int"), "month": F.month(day), "quarter": F.quarter(day), "weekday": F.weekday(day)}


def closed_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Histogram bin from 1; the last one holds its upper edge too."""
    return F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))


def drawn(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 drawn by a digest of ``parts``, the same on every run and in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
