"""From a source table and a specification to prepared tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import INTERVALS, series_key, steps_between, truncated
from tallyforge.sources.shared import with_places
from tallyforge.spec import ANCHOR, LOWER, ROW, SERIES, STEP, UNIT_DAYS, UPPER, PrepSpec, SpecError

PREDICT, SINCE = "__predict", "__since"


def numbered(source: DataFrame, order: list | None = None) -> DataFrame:
    """``source`` with ``__row``, an ordinal from 0.

    With ``order`` (columns that name a total order) rows are range-partitioned by it and numbered by position;
    without, the order in which the source is read counts, which only a single file fixes.
    """
    return with_places(source, order, ROW)


def filtered(source: DataFrame, spec: PrepSpec) -> DataFrame:
    """Rows that the specification's condition lets through, flagged by whether they may be predicted."""
    rows = source.where(F.expr(spec.where)) if spec.where else source
    flag = F.coalesce(F.expr(spec.predict_where), F.lit(False)) if spec.predict_where else F.lit(True)
    return rows.withColumn(PREDICT, flag)


def _typed(spec: PrepSpec, names: list[str], kind: str) -> list[Column]:
    return [F.col(n).cast(kind).alias(n) for n in names]


def typed_rows(source: DataFrame, spec: PrepSpec) -> DataFrame:
    """``__row, __anchor, __predict`` and the typed columns of rows that have an anchor; ``__since`` where waiting
    begins at a column of its own."""
    target = spec.with_role("target")[0]
    rows = filtered(source, spec).withColumn(ANCHOR, F.to_date(F.col(spec.with_role("anchor")[0])))
    kind = "string" if spec.task == "classification" else "double"
    since = [F.to_date(F.col(spec.censor.anchor)).alias(SINCE)] if spec.censor and spec.censor.anchor else []
    return rows.where(F.col(ANCHOR).isNotNull()).select(ROW, ANCHOR, PREDICT, *since, *_typed(spec, spec.with_role("dimension"), "string"), *_typed(spec, spec.with_role("measure"), "double"), F.col(target).cast(kind).alias(target))


def with_bounds(typed: DataFrame, spec: PrepSpec) -> DataFrame:
    """Adds ``__lower`` and ``__upper``: equal where the target is known; from the time waited by the export date
    up to infinity where it is open; null for classes.

    Waiting begins at the anchor or at the column that the censoring names; the export date is the given one or else
    the latest of those dates.
    """
    target = F.col(spec.with_role("target")[0])
    if spec.task == "classification":
        return typed.withColumn(LOWER, F.lit(None).cast("double")).withColumn(UPPER, F.lit(None).cast("double"))
    if not spec.censor:
        return typed.withColumn(LOWER, target).withColumn(UPPER, target)
    begin = SINCE if spec.censor.anchor else ANCHOR
    if spec.censor.as_of:
        dated, as_of = typed, F.lit(spec.censor.as_of).cast("date")
    else:
        latest = typed.agg(F.max(begin).alias("__as_of"))  # one row
        dated, as_of = typed.join(F.broadcast(latest)), F.col("__as_of")
    waited = F.datediff(as_of, F.col(begin)) / UNIT_DAYS[spec.censor.unit]
    open_ = target.isNull()
    return dated.withColumn(LOWER, F.when(open_, waited).otherwise(target)).withColumn(UPPER, F.when(open_, F.lit(float("inf"))).otherwise(target)).drop("__as_of", SINCE)


def prepare_rows(source: DataFrame, spec: PrepSpec) -> tuple[DataFrame, DataFrame]:
    """``(rows, predict)``: one row per case, and the open cases that may be predicted."""
    if spec.mode != "row":
        raise SpecError("this specification is not about rows")
    bounds = with_bounds(typed_rows(source, spec), spec)
    target = F.col(spec.with_role("target")[0])
    return bounds.drop(PREDICT), bounds.where(target.isNull() & F.col(PREDICT)).drop(PREDICT)


def row_summary(source: DataFrame, spec: PrepSpec) -> DataFrame:
    """One row of counts, taken in one pass."""
    target, anchor = F.col(spec.with_role("target")[0]), F.to_date(F.col(spec.with_role("anchor")[0]))
    passes = F.coalesce(F.expr(spec.where), F.lit(False)) if spec.where else F.lit(True)
    may = F.coalesce(F.expr(spec.predict_where), F.lit(False)) if spec.predict_where else F.lit(True)
    valid = passes & anchor.isNotNull()
    counts = {"source_rows": F.lit(True), "rows_after_where": passes, "dropped_null_anchor": passes & anchor.isNull(), "rows": valid, "open_rows": valid & target.isNull(), "known_rows": valid & target.isNotNull(), "predict_rows": valid & target.isNull() & may}
    return source.agg(*[F.count_if(c).alias(name) for name, c in counts.items()], F.max(F.when(valid, anchor)).alias("as_of"))


def infer_step(source: DataFrame, time: str, where: str | None = None) -> DataFrame:
    """One row ``median_gap, step``: the step nearest the median gap between distinct dates.

    The window runs over distinct dates only, of which there are few however many rows.
    """
    rows = source.where(F.expr(where)) if where else source
    days = rows.select(F.to_date(F.col(time)).alias("t")).where("t IS NOT NULL").distinct()
    gaps = days.select(F.datediff("t", F.lag("t").over(Window.orderBy("t"))).alias("gap"))
    gap = F.col("median_gap")
    step = F.when(gap.isNull() | (gap <= 1.5), "day").when(gap <= 8, "week").when(gap <= 35, "month").when(gap <= 100, "quarter").otherwise("year")
    return gaps.agg(F.median("gap").alias("median_gap")).withColumn("step", step)


def step_of(source: DataFrame, spec: PrepSpec) -> str:
    return spec.step or infer_step(source, spec.with_role("time")[0], spec.where).first()["step"]


def history(source: DataFrame, spec: PrepSpec, step: str) -> DataFrame:
    """Typed rows with a date, before the step that holds the export date, and their step."""
    rows = source.where(F.expr(spec.where)) if spec.where else source
    rows = rows.withColumn("__time", F.to_date(F.col(spec.with_role("time")[0]))).where("__time IS NOT NULL")
    if spec.as_of:
        rows = rows.where(F.col("__time") < truncated(F.lit(spec.as_of).cast("date"), step))
    values = spec.with_role("measure", "target")
    order = [F.col(c).alias(f"__tie{i}") for i, c in enumerate(spec.extra.get("order", ()))]
    return rows.select(truncated(F.col("__time"), step).alias(STEP), "__time", *order, *_typed(spec, spec.with_role("dimension"), "string"), *_typed(spec, values, "double"))


def rolled(name: str, how: str, ties: list[str]) -> Column:
    """One aggregate of a step; ``last`` takes the latest known value, of equal dates the one first in tie order."""
    value = F.col(name)
    if how == "last":
        place = F.struct(F.col("__time"), *[(-F.col(t)) for t in ties]) if ties else F.struct("__time")
        return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), place)).alias(name)
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[how](value).alias(name)


def grouped_steps(source: DataFrame, spec: PrepSpec, step: str) -> DataFrame:
    """One row per step and combination of dimension values that occurs."""
    rows = history(source, spec, step)
    ties = [c for c in rows.columns if c.startswith("__tie")]
    dims = spec.with_role("dimension")
    values = [rolled(n, spec.column(n).aggregation, ties) for n in spec.with_role("measure", "target")]
    return rows.groupBy(STEP, *dims).agg(*values).withColumn(SERIES, series_key(dims))


def panel(source: DataFrame, spec: PrepSpec, step: str | None = None) -> DataFrame:
    """A row for every step of every series between its first and last: sums and counts are 0 where nothing
    happened, last values are carried on, others stay null.

    The grid comes from one row per series, so facts are shuffled once for the roll-up and once by series.
    """
    step = step or step_of(source, spec)
    dims = spec.with_role("dimension")
    facts = grouped_steps(source, spec, step)
    spans = facts.groupBy(SERIES, *dims).agg(F.min(STEP).alias("first"), F.max(STEP).alias("last"))
    grid = spans.select(SERIES, *dims, F.explode(steps_between(F.col("first"), F.col("last"), step)).alias(STEP))
    names = spec.with_role("measure", "target")
    rows = grid.join(facts.select(SERIES, STEP, *names), [SERIES, STEP], "left")
    before = Window.partitionBy(SERIES).orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)

    def filled(name: str) -> Column:
        how = spec.column(name).aggregation
        if how in ("sum", "count"):
            return F.coalesce(F.col(name), F.lit(0.0)).cast("double").alias(name)
        return (F.last(name, ignorenulls=True).over(before) if how == "last" else F.col(name)).alias(name)

    return rows.select(STEP, SERIES, *dims, *[filled(n) for n in names])


def scaffold(source: DataFrame, spec: PrepSpec, step: str | None = None) -> DataFrame:
    """The next ``horizon`` steps for every combination of dimension values."""
    step = step or step_of(source, spec)
    dims = spec.with_role("dimension")
    rows = history(source, spec, step)
    combos = rows.select(*dims).distinct() if dims else rows.select(F.lit(1).alias("__one")).distinct()
    unit = F.expr(INTERVALS[step])
    last = rows.agg(F.max(STEP).alias("last"))  # one row
    ahead = last.select(F.explode(F.sequence((F.col("last") + unit).cast("date"), (F.col("last") + F.expr(f"{spec.horizon} * {INTERVALS[step]}")).cast("date"), unit)).alias(STEP))  # horizon rows
    return combos.join(F.broadcast(ahead)).select(STEP, series_key(dims).alias(SERIES), *dims)


def series_summary(source: DataFrame, spec: PrepSpec, step: str | None = None) -> DataFrame:
    """One row of counts of a series preparation."""
    step = step or step_of(source, spec)
    rows = source.where(F.expr(spec.where)) if spec.where else source
    day = F.to_date(F.col(spec.with_role("time")[0]))
    before = day < truncated(F.lit(spec.as_of).cast("date"), step) if spec.as_of else day.isNotNull()
    heads = rows.agg(F.count("*").alias("source_rows"), F.count_if(day.isNull()).alias("dropped_null_time"), F.count_if(day.isNotNull() & ~before).alias("dropped_after_as_of"))
    body = panel(source, spec, step).agg(F.count_distinct(SERIES).alias("series"), F.count("*").alias("panel_rows"), F.max(STEP).alias("as_of"))
    ahead = scaffold(source, spec, step).agg(F.count("*").alias("scaffold_rows"))
    return heads.join(F.broadcast(body)).join(F.broadcast(ahead)).withColumn("step", F.lit(step)).withColumn("horizon", F.lit(spec.horizon))


def as_date(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])
