"""Model inputs from prepared tables; nothing after a row's origin, and no level outside training, is read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.expressions import calendar, step_index, steps_between
from tallyforge.sources.shared import with_places, written
from tallyforge.spec import ANCHOR, SERIES, STEP, PrepSpec

# The last horizons of the stretches that get a model each, and the features' lags, windows and rates.
BUCKET_ENDS = (1, 4, 8, 13, 26, 52)
LAGS, WINDOWS, ALPHAS = (0, 1, 2, 3), (4, 8, 13, 26, 52), (0.1, 0.3, 0.5)


def buckets_for(horizon: int) -> list[tuple[int, int]]:
    """The stretches of the horizon that get a model each."""
    ends = [*(end for end in BUCKET_ENDS if end < horizon), horizon]
    return list(zip([1, *(end + 1 for end in ends)], ends))


def level_codes(train: DataFrame, dim: str) -> DataFrame:
    """``level, code, frequency`` of a dimension's training levels by name; one row per level, of which there may be many."""
    counts = train.groupBy(F.col(dim).alias("level")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    named = with_places(counts.where("level IS NOT NULL AND level <> ''").join(F.broadcast(total)), ["level"], "code")
    return named.select("level", F.col("code").cast("double").alias("code"), (F.col("n") / F.col("total")).alias("frequency"))


def row_features(rows: DataFrame, train: Column, spec: PrepSpec, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` as ``keep`` columns and features, and each feature's family.

    ``train`` marks the rows that levels, frequencies, minima and the trend's origin are taken from.
    """
    seen = rows.where(train)
    dims = [d for d in spec.predictors() if d in spec.with_role("dimension")]
    measures = [m for m in spec.predictors() if m in spec.with_role("measure")]
    heads = seen.agg(F.min(ANCHOR).alias("__start"), *[F.min(m).alias(f"__min_{m}") for m in measures]).first()
    out, families, made = rows, {}, []
    for d in dims:
        levels = level_codes(seen, d).select(F.col("level").alias(f"__{d}"), F.col("code").alias(f"{d}_code"), F.col("frequency").alias(f"{d}_frequency"))
        out = out.join(levels, F.col(d) == F.col(f"__{d}"), "left").withColumn(f"{d}_frequency", F.coalesce(f"{d}_frequency", F.lit(0.0)))
        families |= {f"{d}_code": f"dim:{d}", f"{d}_frequency": f"freq:{d}"}
        made += [F.col(f"{d}_code"), F.col(f"{d}_frequency")]
    for m in measures:
        families[m] = f"measure:{m}"
        made.append(F.col(m))
        if heads[f"__min_{m}"] is not None and heads[f"__min_{m}"] >= 0:
            families[f"{m}_log"] = f"log:{m}"
            made.append(F.log1p(m).alias(f"{m}_log"))
    for part, value in calendar(F.col(ANCHOR)).items():
        families[f"anchor_{part}"] = f"date:{part}"
        made.append(value.cast("double").alias(f"anchor_{part}"))
    families["anchor_years"] = "date:trend"
    made.append((F.datediff(F.col(ANCHOR), F.lit(heads["__start"]).cast("date")) / 365.25).alias("anchor_years"))
    return out.select(*[F.col(c) for c in keep if c not in measures], *made), families


def extended(panel: DataFrame, spec: PrepSpec, step: str) -> DataFrame:
    """The panel with every series carried to the last step of all, by the rule of each column's aggregation."""
    dims, names = spec.with_role("dimension"), spec.with_role("measure", "target")
    last = panel.agg(F.max(STEP).alias("__last"))  # one row
    ends = panel.groupBy(SERIES, *dims).agg(F.max(STEP).alias("__end")).join(F.broadcast(last)).where("__end < __last")
    more = ends.select(SERIES, *dims, F.explode(F.slice(steps_between(F.col("__end"), F.col("__last"), step), F.lit(2), F.greatest(F.size(steps_between(F.col("__end"), F.col("__last"), step)) - 1, F.lit(0)))).alias(STEP))
    fills = [F.lit(0.0 if spec.column(n).aggregation in ("sum", "count") else None).cast("double").alias(n) for n in names]
    both = panel.select(STEP, SERIES, *dims, *names, F.lit(True).alias("own")).unionByName(more.select(STEP, SERIES, *dims, *fills, F.lit(False).alias("own")))
    before = Window.partitionBy(SERIES).orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)
    carried = {n: F.when(F.col("own"), F.col(n)).otherwise(F.last(n, ignorenulls=True).over(before)) for n in names if spec.column(n).aggregation == "last"}
    return both.withColumns(carried) if carried else both


def rolling(value: Column, window: int, over) -> dict[str, Column]:
    """Mean, population deviation, maximum and share of zeros of the last ``window`` places, once half are known."""
    frame = over.rowsBetween(-window + 1, 0)
    enough = F.count(value).over(frame) >= max(window // 2, 1)
    zero = F.when(value == 0, 1.0).when(value.isNotNull(), 0.0)
    parts = {"mean": F.avg(value), "std": F.stddev_pop(value), "max": F.max(value), "zeros": F.avg(zero)}
    return {name: F.when(enough, part.over(frame)) for name, part in parts.items()}


def smoothed(values: DataFrame, value: str, alphas=ALPHAS, parts: int | None = None) -> DataFrame:
    """``values`` with ``ewm<100 alpha>``: exponentially weighted levels that hold through gaps.

    A level is linear in the one before, so a stretch of a series is known by how much of the level before it is left at
    its end and what it adds. Series are sorted by range over all tasks; a task smooths what it holds as batches come by,
    the one series that may have begun in an earlier part as if from nothing. One small row for each part tells how
    these stretches end; folding them gives the level at which each begins, and its share is added to every row.
    """
    from pyspark import TaskContext

    names, rates = [f"ewm{round(a * 100)}" for a in alphas], list(alphas)
    spark, plain = values.sparkSession, T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    marks = T.StructType.fromDDL("__part long, __open boolean, __known long")
    shape = T.StructType([*values.schema.fields, *plain.fields, *marks.fields])

    def run(frames):
        part, first, now, known, level = TaskContext.get().partitionId(), True, None, 0, None
        for frame in frames:
            series, x = frame[SERIES].to_numpy(), frame[value].to_numpy(dtype="float64", na_value=float("nan"))
            out, count, open_ = [], [], []
            for s, v in zip(series, x.tolist()):
                if level is None or s != now:
                    first = level is None
                    now, known, level = s, 0, ([0.0] * len(rates) if first else [None] * len(rates))
                if v == v:
                    known += 1
                    level = [v if had is None else (1 - a) * had + a * v for had, a in zip(level, rates)]
                out.append(level)
                count.append(known)
                open_.append(first)
            columns = list(zip(*out)) if out else [()] * len(names)
            frame = frame.assign(**{n: pd.Series(c, dtype="float64", index=frame.index) for n, c in zip(names, columns)})
            yield frame.assign(__part=part, __open=open_, __known=count)

    spread = values.repartitionByRange(parts, SERIES, STEP) if parts else values.repartitionByRange(SERIES, STEP)
    stored = written(spread.sortWithinPartitions(SERIES, STEP).mapInPandas(run, shape))
    ended = F.struct(STEP, *names)
    seen = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.struct(STEP, F.col(value).cast("double").alias("x")))
    cut = F.broadcast(stored.where("__open").select(SERIES).distinct())  # a series for each part at most
    ends = stored.join(cut, SERIES, "left_semi").groupBy(SERIES, "__part").agg(F.max(ended).alias("end"), F.max("__known").alias("known"), F.min(seen)["x"].alias("x"), F.bool_or("__open").alias("open"))
    starts, before = [], {}
    for row in ends.orderBy(SERIES, "__part").collect():  # the parts of these series, two rows for each part at most
        had = before.get(row[SERIES])
        begin = had or ([row["x"]] * len(names) if row["x"] is not None else None)
        if row["open"]:
            starts.append((row["__part"], had is not None, *(begin or [None] * len(names))))
        if begin:
            before[row[SERIES]] = [row["end"][n] + (1 - a) ** row["known"] * b for n, a, b in zip(names, rates, begin)] if row["open"] else [row["end"][n] for n in names]
    told = spark.createDataFrame(starts, "__of long, __carried boolean, " + ", ".join(f"__{n} double" for n in names))
    both = stored.join(F.broadcast(told), F.col("__open") & (F.col("__part") == F.col("__of")), "left")  # a row for each part
    levels = [F.when(~F.col("__open"), F.col(n)).when((F.col("__known") > 0) | F.col("__carried"), F.col(n) + F.pow(F.lit(1 - a), F.col("__known")) * F.col(f"__{n}")).alias(n) for n, a in zip(names, rates)]
    return both.select(*values.columns, *levels)


def origin_features(panel: DataFrame, spec: PrepSpec, step: str, bucket: int, period: int | None = None, measure_lags: dict[str, int] | None = None, with_ewm: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """``__series, index`` and what is known at each origin, every value from the origin or before; and families."""
    target, measures = spec.with_role("target")[0], spec.with_role("measure")
    rows = extended(panel, spec, step)
    order = Window.partitionBy(SERIES).orderBy(STEP)
    cols, families = {}, {}

    def add(name, family, col):
        cols[name] = col
        families[name] = family

    for j in LAGS:
        add(f"lag_{bucket + j}", f"lag+{j}", F.lag(target, j).over(order) if j else F.col(target))
    if period and period >= bucket:
        add(f"lag_{period}_season", "season", F.lag(target, period - bucket).over(order) if period > bucket else F.col(target))
    for w in WINDOWS:
        for stat, col in rolling(F.col(target), w, order).items():
            add(f"roll{w}_{stat}", f"roll:{w}", col)
    for m in measures:
        for j in LAGS:
            add(f"{m}_lag_{bucket + j}", f"measure:{m}", F.lag(m, j).over(order) if j else F.col(m))
        k = (measure_lags or {}).get(m)
        if k and k >= bucket:
            add(f"{m}_lead_{k}", f"lead:{m}", F.lag(m, k - bucket).over(order) if k > bucket else F.col(m))
    if with_ewm:
        rows = smoothed(rows, target)
        families |= {f"ewm{round(a * 100)}": f"ewm:{a}" for a in ALPHAS}
    ewm = [f"ewm{round(a * 100)}" for a in ALPHAS] if with_ewm else []
    return rows.select(SERIES, step_index(F.col(STEP), step).alias("index"), *ewm, *[c.alias(n) for n, c in cols.items()]), families


def series_features(panel: DataFrame, scaffold: DataFrame, spec: PrepSpec, bucket: tuple[int, int], step: str, train: Column, period: int | None = None, measure_lags: dict[str, int] | None = None, with_ewm: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """``series, step, origin, future, y`` and features: the rows one bucket's model learns from and predicts.

    A target at step d is joined to what was known at d - b, b the bucket's last horizon, and to d's calendar;
    future rows are the scaffold's steps at horizons within the bucket.
    """
    lo, b = bucket
    dims, target = spec.with_role("dimension"), spec.with_role("target")[0]
    base, families = origin_features(panel, spec, step, b, period, measure_lags, with_ewm)
    last = panel.agg(F.max(step_index(F.col(STEP), step)).alias("__last"))  # one row
    past = panel.select(F.col(SERIES).alias("series"), *dims, F.col(STEP).alias("step"), F.col(target).alias("y"), F.lit(False).alias("future"))
    ahead = scaffold.select(F.col(SERIES).alias("series"), *dims, F.col(STEP).alias("step"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("future"))
    horizon = step_index(F.col("step"), step) - F.col("__last")
    ahead = ahead.join(F.broadcast(last)).where((horizon >= lo) & (horizon <= b)).drop("__last")
    rows = past.unionByName(ahead).withColumn("__at", step_index(F.col("step"), step) - b)
    base = base.withColumnRenamed(SERIES, "__series_of")
    frame = rows.join(base, (F.col("series") == F.col("__series_of")) & (F.col("__at") == F.col("index")))
    for part, value in calendar(F.col("step")).items():
        if part != "weekday" or step == "day":
            frame = frame.withColumn(f"cal_{part}", value.cast("double"))
            families[f"cal_{part}"] = f"cal:{part}"
    for d in dims:
        levels = level_codes(panel.where(train), d).select(F.col("level").alias(f"__{d}"), F.col("code").alias(f"{d}_code"))
        frame = frame.join(levels, F.col(d) == F.col(f"__{d}"), "left")
        families[f"{d}_code"] = f"dim:{d}"
    days = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}[step]  # to date the origin for display
    return frame.select("series", "step", F.date_sub("step", b * days).alias("origin"), "future", "y", *families), families


def picked(families: dict[str, str], wanted: set[str]) -> list[str]:
    """Names of the features of the wanted families."""
    return [name for name, family in families.items() if family in wanted]


def map_features(rows: DataFrame, features: str = "features") -> DataFrame:
    """Every feature name of the maps in one sorted list; one row."""
    return rows.select(F.explode(F.map_keys(features)).alias("name")).distinct().agg(F.array_sort(F.collect_list("name")).alias("names"))
