"""What the training rows look like, from them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import known
from tallyforge.spec import LOWER, SERIES, STEP, UPPER, PrepSpec

# What counts as a season, the longest lead, what counts as a leak, the shortest season.
SEASON_ACF, MAX_LAG, LEAK_CORRELATION, MIN_LAG = 0.3, 26, 0.99, 4


def number_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: missing share, mean, population deviation, range, share of zeros; one pass."""

    def stats(c: str) -> Column:
        v = F.when(known(F.col(c)), F.col(c).cast("double"))
        return F.struct(F.lit(c).alias("column"), (1 - F.count(v) / F.count("*")).alias("missing"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(F.when(v == 0, 1.0).when(v.isNotNull(), 0.0)).alias("zeros"))

    return rows.agg(F.array(*[stats(c) for c in columns]).alias("s")).select(F.inline("s"))


def text_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per text column: missing share (empty counts as missing) and number of levels."""

    def stats(c: str) -> Column:
        v = F.when(F.col(c) != "", F.col(c))
        return F.struct(F.lit(c).alias("column"), (1 - F.count(v) / F.count("*")).alias("missing"), F.count_distinct(v).alias("levels"))

    return rows.agg(F.array(*[stats(c) for c in columns]).alias("s")).select(F.inline("s"))


def top_levels(rows: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """``column, rank, level, n``: the most frequent levels, of equal counts the last by name."""
    pairs = rows.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))).alias("column", "level"))
    counts = pairs.where("level IS NOT NULL AND level <> ''").groupBy("column", "level").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("level").desc())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("column", "rank", "level", "n")


def leaks(rows: DataFrame, measures: list[str], target: str) -> DataFrame:
    """One row per measure: whether it is the target in disguise, by a constant gap or by correlation; one pass."""
    y = F.col(target).cast("double")

    def test(m: str) -> Column:
        v = F.col(m).cast("double")
        both = known(v) & known(y)
        only = lambda x: F.when(both, x)
        n, gap, own = F.count(only(y)), F.stddev_pop(only(v - y)), F.stddev_pop(only(y))
        corr = F.when(F.stddev_pop(only(v)) > 0, F.corr(only(v), only(y)))
        tested = (n >= 10) & (own > 0)
        reason = F.when(tested & (gap <= 0.01 * own), "constant gap").when(tested & (F.abs(corr) >= LEAK_CORRELATION), "correlation")
        return F.struct(F.lit(m).alias("measure"), n.alias("n"), F.when(tested, gap / own).alias("gap_ratio"), F.when(tested, corr).alias("correlation"), reason.alias("reason"))

    return rows.agg(F.array(*[test(m) for m in measures]).alias("t")).select(F.inline("t"))


def step_totals(panel: DataFrame, target: str) -> DataFrame:
    """``__step, pos, total`` over all series; the window runs over distinct steps only."""
    totals = panel.groupBy(STEP).agg(F.sum(F.coalesce(F.col(target), F.lit(0.0))).alias("total"))
    return totals.withColumn("pos", (F.row_number().over(Window.orderBy(STEP)) - 1).cast("long"))


def trend(totals: DataFrame) -> DataFrame:
    """One row ``steps, mean_total, slope, trend_per_step``."""
    slope = F.when(F.count("*") > 2, F.regr_slope("total", F.col("pos").cast("double"))).otherwise(0.0)
    row = totals.agg(F.count("*").alias("steps"), F.avg("total").alias("mean_total"), slope.alias("slope"))
    return row.withColumn("trend_per_step", F.when(F.col("mean_total") != 0, F.col("slope") / F.col("mean_total")).otherwise(0.0))


def autocorrelation(totals: DataFrame, max_lag: int = 60) -> DataFrame:
    """``lag, acf`` of the totals without their linear trend, for lags below half the length."""
    fit = totals.agg(F.regr_slope("total", F.col("pos").cast("double")).alias("m"), F.regr_intercept("total", F.col("pos").cast("double")).alias("c"), F.count("*").alias("n"))  # one row
    flat = totals.join(F.broadcast(fit)).select("pos", "n", F.when(F.col("n") > 2, F.col("total") - F.col("m") * F.col("pos") - F.col("c")).otherwise(F.col("total")).alias("v"))
    scale = flat.agg(F.sum(F.col("v") * F.col("v")).alias("d"))  # one row
    # Steps are few: each lag shifts the whole column by an equi-join on the place.
    lags = flat.select("pos", "v", F.explode(F.expr(f"CASE WHEN least({max_lag}, n div 2) > 1 THEN sequence(1L, least({max_lag}L, n div 2) - 1) ELSE array() END")).alias("lag"))
    earlier = flat.select(F.col("pos").alias("__p"), F.col("v").alias("w"))
    pairs = lags.join(earlier, F.col("pos") - F.col("lag") == F.col("__p"))
    return pairs.groupBy("lag").agg(F.sum(F.col("v") * F.col("w")).alias("s")).join(F.broadcast(scale)).where("d <> 0").select(F.col("lag").cast("long").alias("lag"), (F.col("s") / F.col("d")).alias("acf"))


def season(acf: DataFrame) -> DataFrame:
    """One row ``period, strength``: the strongest peak after the first dip at four steps or more; both null if none.

    The windows run over some sixty lags.
    """
    order = Window.orderBy("lag")
    near = acf.withColumns({"prev": F.lag("acf").over(order), "next": F.lead("acf").over(order)})
    dip = (F.col("prev").isNotNull()) & (F.col("next").isNotNull()) & (F.col("acf") <= F.col("next"))
    near = near.withColumn("dip", F.min(F.when(dip, F.col("lag"))).over(Window.partitionBy()))
    peak = (F.col("lag") > F.col("dip")) & (F.col("acf") >= F.col("prev")) & (F.col("acf") >= F.col("next")) & (F.col("lag") >= MIN_LAG)
    best = near.agg(F.max(F.when(peak, F.struct("acf", "lag"))).alias("b"))
    return best.select(F.col("b.lag").alias("period"), F.col("b.acf").alias("strength"))


def lead_lags(panel: DataFrame, measure: str, target: str, max_lag: int = MAX_LAG) -> DataFrame:
    """``lag, n, corr``: how a measure's changes match the target's changes ``lag`` steps later, all series pooled."""
    order = Window.partitionBy(SERIES).orderBy(STEP)
    diffs = panel.select(SERIES, F.row_number().over(order).alias("pos"), (F.col(measure) - F.lag(measure).over(order)).alias("dm"), (F.col(target) - F.lag(target).over(order)).alias("dy"))
    early = diffs.where("dm IS NOT NULL").select(SERIES, "dm", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "pos").withColumn("at", F.col("pos") + F.col("lag"))
    late = diffs.where("dy IS NOT NULL").select(F.col(SERIES).alias("__s"), F.col("pos").alias("__p"), "dy")
    pairs = early.join(late, (F.col(SERIES) == F.col("__s")) & (F.col("at") == F.col("__p")))
    tested = (F.count("*") >= 10) & (F.stddev_pop("dm") > 0) & (F.stddev_pop("dy") > 0)
    return pairs.groupBy("lag").agg(F.count("*").alias("n"), F.when(tested, F.corr("dm", "dy")).alias("corr")).where("corr IS NOT NULL")


def best_lead(lags: DataFrame) -> DataFrame:
    """One row ``lag, corr, n``: the strongest, of equal ones the shortest."""
    best = lags.agg(F.max(F.struct(F.abs("corr").alias("a"), (-F.col("lag")).alias("l"), "corr", "n")).alias("b"))
    return best.select((-F.col("b.l")).alias("lag"), F.col("b.corr").alias("corr"), F.col("b.n").alias("n"))


def censored_share(rows: DataFrame) -> DataFrame:
    open_ = known(F.col(LOWER)) & (F.col(UPPER) == float("inf"))
    return rows.agg(F.avg(F.when(open_, 1.0).otherwise(0.0)).alias("censored"))


def zero_shares(panel: DataFrame, target: str) -> DataFrame:
    """One row ``series, median, max`` of the series' shares of zeros."""
    each = panel.groupBy(SERIES).agg(F.avg(F.when(F.col(target) == 0, 1.0).otherwise(0.0)).alias("z"))
    return each.agg(F.count("*").alias("series"), F.median("z").alias("median"), F.max("z").alias("max"))


def build_profile(train: DataFrame, spec: PrepSpec) -> dict:
    """The profile of training rows as a small dict of scalars: what the search starts from."""
    target, measures = spec.with_role("target")[0], spec.with_role("measure")
    numbers = measures + ([target] if spec.task == "regression" else [])
    profile: dict = {"mode": spec.mode, "rows": train.count(), "columns": {}, "leaks": {}}
    for row in number_stats(train, numbers).collect() if numbers else ():
        profile["columns"][row["column"]] = row.asDict()
    if spec.task == "regression" and measures:
        profile["leaks"] = {r["measure"]: r["reason"] for r in leaks(train, measures, target).collect() if r["reason"]}
    if spec.mode == "row":
        profile["censored"] = censored_share(train).first()["censored"] or 0.0 if LOWER in train.columns else 0.0
    else:
        totals = step_totals(train, target)
        found = season(autocorrelation(totals)).first()
        strong = found["period"] is not None and found["strength"] >= SEASON_ACF
        zeros = zero_shares(train, target).first()
        profile |= {"period": found["period"] if strong else None, "period_acf": found["strength"] or 0.0, "trend_per_step": trend(totals).first()["trend_per_step"], "series": zeros["series"], "zero_share": {"median": zeros["median"], "max": zeros["max"]}}
        profile["leads"] = {m: best_lead(lead_lags(train, m, target)).first().asDict() for m in measures}
    profile["genes"] = suggest_genes(spec, profile)
    return profile


def suggest_genes(spec: PrepSpec, profile: dict) -> dict:
    """Objectives that suit the target, leaking inputs to leave out, the season and useful lags."""
    own = profile["columns"].get(spec.with_role("target")[0], {})
    quiet = profile["zero_share"]["median"] if "zero_share" in profile else own.get("zeros")
    counts = own.get("min") is not None and own["min"] >= 0 and (quiet or 0) > 0.3
    wanted = {"logistic": spec.task == "classification", "squared": spec.task == "regression", "absolute": spec.task == "regression", "tweedie": spec.task == "regression" and counts, "poisson": spec.task == "regression" and counts, "aft": profile.get("censored", 0) > 0}
    genes = {"objectives": [name for name, fits in wanted.items() if fits], "exclude": sorted(profile["leaks"])}
    if spec.mode == "series":
        # A correlation of noise stays within 2 / sqrt(n) nineteen times in twenty.
        leads = {m: v for m, v in profile.get("leads", {}).items() if v["n"]}
        genes |= {"period": profile.get("period"), "measure_lags": {m: v["lag"] for m, v in leads.items() if v["corr"] ** 2 * v["n"] > 4}}
    return genes
