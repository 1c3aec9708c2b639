"""What is looked at after a run: totals by step, bands, loads by week, tables and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import all_of, known
from tallyforge.operators.evaluate import apply_band, fit_band
from tallyforge.spec import SERIES, STEP

MAX_LINES, MAX_BREAKDOWN, DRAWS = 12, 3, 200
#: Quantiles by which the residuals of a simulated band stand.
RESIDUAL_POINTS = 1000


def filter_dims(rows: DataFrame, filters: dict[str, list], dims: list[str]) -> DataFrame:
    """Rows whose dimensions have one of the wanted values; filters on other columns are left out."""
    return rows.where(all_of(F.col(d).isin(values) for d, values in filters.items() if d in dims))


def breakdown_of(names: list[str], dims: list[str]) -> list[str]:
    return [n for n in dict.fromkeys(names) if n in dims][:MAX_BREAKDOWN]


def label_of(breakdown: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("None")) for d in breakdown]) if breakdown else F.lit("all")


def capped_lines(rows: DataFrame, breakdown: list[str], most: int = MAX_LINES) -> DataFrame:
    """Rows of the first ``most`` combinations, by value: the cap is the chart's own."""
    if not breakdown:
        return rows
    lines = rows.select(*breakdown).distinct().orderBy(*breakdown).limit(most)
    on = all_of(F.col(d).eqNullSafe(F.col(f"__{d}")) for d in breakdown)
    return rows.join(lines.select(*[F.col(d).alias(f"__{d}") for d in breakdown]), on, "left_semi")


def keymap(panel: DataFrame, dims: list[str]) -> DataFrame:
    """``series`` and its dimension values: one row per series."""
    return panel.select(F.col(SERIES).alias("series"), *dims).distinct()


def actuals(panel: DataFrame, target: str, breakdown: list[str]) -> DataFrame:
    return panel.groupBy(*breakdown, F.col(STEP).alias("step")).agg(F.sum(target).alias("actual"))


def past_forecast(judged: DataFrame, keys: DataFrame, breakdown: list[str]) -> DataFrame:
    """Predictions of validation and test: averaged over buckets that cover one step, then summed."""
    each = judged.groupBy("series", "step").agg(F.avg("prediction").alias("prediction"))
    return each.join(keys, "series").groupBy(*breakdown, "step").agg(F.sum("prediction").alias("forecast"))


def future_forecast(forecast: DataFrame, keys: DataFrame, breakdown: list[str]) -> DataFrame:
    return forecast.join(keys, "series").groupBy(*breakdown, "step", "bucket").agg(F.sum("prediction").alias("prediction"))


def series_band(validation: DataFrame, future: DataFrame, keys: DataFrame, breakdown: list[str], nonnegative: bool = False) -> DataFrame:
    """``future`` with band edges fitted per line and bucket on the residuals of the sums that are shown."""
    sums = validation.join(keys, "series").groupBy(*breakdown, "bucket", "step").agg(F.sum("actual").alias("actual"), F.sum("prediction").alias("prediction"))
    by = [*breakdown, "bucket"]
    return apply_band(future, fit_band(sums, by), by, nonnegative=nonnegative)


def series_view(panel: DataFrame, judged: DataFrame, forecast: DataFrame, dims: list[str], target: str, breakdown: list[str]) -> DataFrame:
    """All lines on one axis: ``label, step, actual, forecast``, one plan for every combination."""
    keys = keymap(panel, dims)
    ahead = future_forecast(forecast, keys, breakdown).groupBy(*breakdown, "step").agg(F.max("prediction").alias("forecast"))
    lines = past_forecast(judged, keys, breakdown).unionByName(ahead).groupBy(*breakdown, "step").agg(F.max("forecast").alias("forecast"))
    both = actuals(panel, target, breakdown).join(lines, [*breakdown, "step"], "full")
    return both.select(label_of(breakdown).alias("label"), "step", "actual", "forecast")


def aligned(lines: DataFrame) -> DataFrame:
    """``label, step, ...`` on a shared axis: every label has every step, with nulls where it has no value."""
    axis, labels = lines.select("step").distinct(), lines.select("label").distinct()
    grid = labels.join(F.broadcast(axis))  # the steps of a chart: no more rows than one series has
    return grid.join(lines, ["label", "step"], "left")


def markers(validation: DataFrame, test: DataFrame, forecast: DataFrame) -> DataFrame:
    """``label, step``: where validation, test and forecast begin."""
    parts = [(validation, "validation start"), (test, "test start"), (forecast, "forecast origin")]
    rows = [df.select(F.lit(name).alias("label"), "step") for df, name in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("label").agg(F.min("step").alias("step"))


def weekly_load(forecast: DataFrame, keys: DataFrame, breakdown: list[str]) -> DataFrame:
    """Predicted cases per Monday week of their predicted date."""
    return forecast.join(keys, "row").groupBy(*breakdown, F.date_trunc("week", "predicted_date").cast("date").alias("week")).agg(F.count("*").alias("n"))


def weekly_actuals(rows: DataFrame, anchor: str, duration: Column, unit_days: float, breakdown: list[str]) -> DataFrame:
    """Resolved cases per Monday week of the day they were resolved, anchor plus the rounded duration."""
    done = F.date_add(F.col(anchor), F.bround(duration * unit_days).cast("int"))
    return rows.where(duration.isNotNull()).groupBy(*breakdown, F.date_trunc("week", done).cast("date").alias("week")).agg(F.count("*").alias("n"))


def group_dates(forecast: DataFrame, keys: DataFrame, group: str) -> DataFrame:
    """Count and the earliest and latest predicted date of each group."""
    return forecast.join(keys, "row").groupBy(group).agg(F.count("*").alias("n"), F.min("predicted_date").alias("earliest"), F.max("predicted_date").alias("latest"))


def series_table(validation: DataFrame, test: DataFrame, forecast: DataFrame) -> DataFrame:
    """All rows of a run with a flag for those to come."""
    past = validation.unionByName(test).withColumns({"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double"), "future": F.lit(False)})
    ahead = forecast.withColumn("future", F.lit(True))
    return past.unionByName(ahead, allowMissingColumns=True)


def row_table(forecast: DataFrame, keys: DataFrame, dims: list[str], unit_days: float) -> DataFrame:
    """Open cases with their dimensions and the band's edges as the days on which they fall."""
    day = lambda edge: F.date_add("anchor", F.round(F.col(edge) * unit_days).cast("int")).alias(edge)
    return forecast.join(keys, "row").select("row", *dims, "anchor", "predicted_date", "prediction", day("lower"), day("upper"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of the sorted rows; ``order`` must name a total order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def shown(rows: DataFrame) -> DataFrame:
    """Numbers that JSON can't hold as nulls, dates as text."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return rows.select(*out)


def load_band(forecast: DataFrame, residuals: DataFrame, unit_days: float, draws: int = DRAWS, seed: int = 7, points: int = RESIDUAL_POINTS) -> DataFrame:
    """``week, lower, upper``: tenth and ninetieth percentile of simulated weekly counts.

    In each draw every case (``anchor, prediction``) resolves ``prediction * (1 + r)`` units after its anchor, r drawn from
    the relative ``resid`` uals of validation cases. Cases of one anchor that are expected to wait equally long, to a
    tenth of a day, are counted first, and each draw deals a count out over weeks at once by their chances, so the work
    does not grow with cases times draws. A count's draws depend on its day, its wait and ``seed``, so reruns agree. Weeks
    that a draw leaves empty count as 0. Residuals stand as ``points`` quantiles of all of them.

    Without any case or residual the result is empty.
    """
    import datetime as dt

    import numpy as np
    import pyarrow as pa

    shares = F.array(*[F.lit((k + 0.5) / points) for k in range(points)])
    pool = residuals.select(F.col("resid").cast("double").alias("resid")).where(known(F.col("resid"))).agg(F.percentile_approx("resid", shares, 100_000).alias("r")).first()["r"]
    factor = 1 + np.array(pool or [], dtype=np.float64)
    days = F.col("prediction") * unit_days
    alike = forecast.where(F.col("anchor").isNotNull() & known(F.col("prediction"))).groupBy(F.unix_date(F.col("anchor").cast("date")).alias("day"), F.round(days * 10).cast("long").alias("wait")).agg(F.count("*").alias("n"), F.avg(days).alias("days"))

    def deal(batches):
        first, total = 0, np.zeros((0, draws), dtype=np.int64)  # of weeks from the first on
        for batch in batches:
            for day, wait, n, days in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not len(factor):
                    continue
                weeks = (day + np.round(days * factor).astype(np.int64) + 3) // 7  # 1970-01-01 was a Thursday
                low, high = int(weeks.min()), int(weeks.max())
                if not len(total) or low < first or high >= first + len(total):
                    start = min(low, first) if len(total) else low
                    grown = np.zeros((max(high + 1, first + len(total)) - start + 64, draws), dtype=np.int64)
                    grown[first - start if len(total) else 0 :][: len(total)] = total
                    first, total = start, grown
                rng = np.random.default_rng([seed, day % 2**32, wait % 2**32])
                times = np.bincount(weeks - low)
                if n < len(times) // 4:  # few cases: one by one costs less than week by week
                    at = weeks[rng.integers(0, len(weeks), (draws, n))] - first
                    np.add.at(total, (at.ravel(), np.repeat(np.arange(draws), n)), 1)
                else:
                    total[low - first : high + 1 - first] += rng.multinomial(n, times / len(factor), size=draws).T
        own = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own + first), pa.array([total[w].astype("<i8").tobytes() for w in own], pa.binary())], ["week", "draws"])

    def add(data: pa.Table) -> pa.Table:
        counts = np.sum([np.frombuffer(x, "<i8") for x in data.column("draws").to_pylist()], axis=0)
        low, high = np.percentile(counts, (10, 90))
        monday = dt.date(1970, 1, 1) + dt.timedelta(days=data.column("week")[0].as_py() * 7 - 3)
        return pa.table([pa.array([monday]), pa.array([low]), pa.array([high])], ["week", "lower", "upper"])

    dealt = alike.repartition(int(forecast.sparkSession.conf.get("spark.sql.shuffle.partitions")), "day", "wait").mapInArrow(deal, "week long, draws binary")
    return dealt.groupBy("week").applyInArrow(add, "week date, lower double, upper double")


def export(rows: DataFrame, trusted: bool) -> DataFrame:
    """``rows`` with the verdict on every line, ready for a CSV sink."""
    return rows.withColumn("verdict", F.lit("trusted" if trusted else "not trusted"))


def leaderboard(entries: DataFrame, top: int = 25) -> DataFrame:
    """The best recipes by fitness and then size."""
    return entries.orderBy("fitness", "size", "recipe").limit(top)


def ranked(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
