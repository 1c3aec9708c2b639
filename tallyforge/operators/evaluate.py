"""How good a forecast is on rows it never saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import all_of, known
from tallyforge.sources.shared import written

# When a forecast may be trusted, the band's level, and the names of the checks.
BASELINE_RATIO, COVERAGE_RANGE, MIN_TEST_ROWS, MIN_TEST_STEPS = 0.9, (0.65, 0.95), 30, 13
LEVEL = 0.8
#: Rows of a group up to which its values are sorted in one task; beyond, over all tasks. The results are the same.
CROWD = 2_000_000
#: Of a sketch's quantiles the places are right to a share of 1 / SKETCH; a bracket reaches twice as far to both sides.
SKETCH = 10_000
BRACKET = 2 / SKETCH
BEATS, CALIBRATED, SHARP, ENOUGH = "beats the naive baseline", "band is calibrated", "band is sharper than the data's own spread", "enough history to judge"


def wape(y: Column, p: Column) -> Column:
    """Aggregate: absolute errors over absolute actuals, where the actual is known."""
    return F.sum(F.when(known(y), F.abs(y - p))) / F.nullif(F.sum(F.when(known(y), F.abs(y))), F.lit(0.0))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.when(known(y), F.abs(y - p)))


def log_loss(code: Column, probabilities: Column) -> Column:
    """Aggregate over a class code from 0 and an array of class probabilities."""
    return F.avg(-F.ln(F.least(F.greatest(F.get(probabilities, code.cast("int")), F.lit(1e-12)), F.lit(1.0))))


def brier(code: Column, probabilities: Column) -> Column:
    hit = F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == code, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.avg(F.aggregate(hit, F.lit(0.0), lambda a, x: a + x))


def open_consistency(p: Column, lower: Column) -> Column:
    """Aggregate: the share of open rows predicted at or beyond what they have waited."""
    return F.avg(F.when(p >= lower, 1.0).otherwise(0.0))


def _may_crowd(rows: DataFrame, most: int) -> bool:
    """Whether Spark's own estimate of all rows' size is above a few bytes for each of ``most`` rows."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 8 * most


def crowded(rows: DataFrame, by: list[str], most: int = CROWD) -> bool:
    """Whether a group has more rows than one task should hold the values of. Where Spark's own estimate of all rows'
    size is below a few bytes for each of ``most`` rows there is nothing to count."""
    if not _may_crowd(rows, most):
        return False
    return (rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > most


def stored(rows: DataFrame, most: int = CROWD) -> DataFrame:
    """``rows``, as a table where there may be too many for one task: what is read several times is worked out once."""
    return written(rows) if _may_crowd(rows, most) else rows


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], spread_out: bool, extra: tuple[Column, ...] = ()) -> DataFrame:
    """``by...`` with the aggregates ``extra`` and exact quantiles, ``wanted`` as name: (value, share); nulls don't count.

    Both ways give the same numbers. One aggregates the values of a group in one task. The other, for crowded groups,
    brackets each quantile by a sketch, counts the values below the bracket where they are, and shuffles only the distinct
    values within it, among which the places next to each share are found. ``rows`` are read twice, no row is shuffled.
    """
    if not spread_out:
        return rows.groupBy(*by).agg(*extra, *[F.percentile(value, share).alias(name) for name, (value, share) in wanted.items()])
    heads, values = [], [value.cast("double") for value, _ in wanted.values()]
    for i, (value, (_, share)) in enumerate(zip(values, wanted.values())):
        edges = F.array(F.lit(max(share - BRACKET, 0.0)), F.lit(min(share + BRACKET, 1.0)))
        heads += [F.count(value).alias(f"__n{i}"), F.percentile_approx(value, edges, SKETCH).alias(f"__e{i}")]
    facts = written(rows.groupBy(*by).agg(*extra, *heads))
    found = _picked(rows, by, wanted, values, facts, True)
    if not found.where(" OR ".join(f"(__n{i} > 0 AND {name} IS NULL)" for i, name in enumerate(wanted))).isEmpty():
        found = _picked(rows, by, wanted, values, facts, False)  # a sketch was off: all distinct values are counted
    return found.drop(*[f"__n{i}" for i in range(len(wanted))])


def _picked(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], values: list[Column], facts: DataFrame, bracketed: bool) -> DataFrame:
    """``facts`` with the quantiles, by the distinct values within their brackets and the number of those below; null
    where a bracket misses the place."""
    keys = [f"__by{i}" for i in range(len(by))]
    edges = facts.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[f"__e{i}" for i in range(len(wanted))])
    both = rows.join(edges, all_of(F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys))) if by else rows.join(F.broadcast(edges))  # one row
    parts = []
    for i, (value, (_, share)) in enumerate(zip(values, wanted.values())):
        low, high = F.get(f"__e{i}", F.lit(0)), F.get(f"__e{i}", F.lit(1))
        below = (value < low) if bracketed and share > BRACKET else F.lit(False)
        above = (value > high) if bracketed and share < 1 - BRACKET else F.lit(False)
        parts.append(F.when(value.isNotNull() & ~above, F.struct(F.lit(i).alias("i"), below.alias("below"), F.when(~below, value).alias("v"))))
    each = both.select(*keys, F.explode(F.array_compact(F.array(*parts))).alias("p"))
    counts = each.groupBy(*keys, F.col("p.i").alias("i"), F.col("p.below").alias("below"), F.col("p.v").alias("v")).agg(F.count("*").alias("c"))
    before = Window.partitionBy(*keys, "i").orderBy(F.desc("below"), "v").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("from", F.coalesce(F.sum("c").over(before), F.lit(0)))
    sizes = facts.select(*[F.col(b).alias(f"{k}f") for b, k in zip(by, keys)], *[f"__n{i}" for i in range(len(wanted))])
    counts = counts.where("NOT below")
    placed = counts.join(sizes, all_of(F.col(k).eqNullSafe(F.col(f"{k}f")) for k in keys)) if by else counts.join(F.broadcast(sizes))  # one row
    near, ends = [], []
    for i, (name, (_, share)) in enumerate(wanted.items()):
        at = (F.col(f"__n{i}") - 1) * share
        holds = lambda place: (F.col("i") == i) & (F.col("from") <= place) & (place < F.col("from") + F.col("c"))  # noqa: B023, E731
        near += [F.max(F.when(holds(edge(at)), F.col("v"))).alias(f"__{side}{i}") for side, edge in (("low", F.floor), ("high", F.ceil))]
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        ends.append(F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    got = placed.groupBy(*keys).agg(*near)
    out = facts.join(got, all_of(F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)), "left") if by else facts.join(F.broadcast(got), how="left")  # one row
    return written(out.select(*by, *[c for c in facts.columns if c not in by and c not in edges.columns], *ends))


def fit_band(rows: DataFrame, by: list[str] | None = None, level: float = LEVEL, relative: bool | None = None, y: str = "actual", p: str = "prediction", most: int = CROWD) -> DataFrame:
    """``by..., lo, hi, relative, floor, n``: quantiles of residuals per group; null edges under four residuals.

    Residuals are relative to the prediction, not below a floor, where all actuals are non-negative and half are
    positive. With 20 or more both tails are taken, with fewer one symmetric width.
    """
    by = by or []
    pairs = rows.where(known(F.col(y)) & known(F.col(p))).select(*by, F.col(y).alias("__y"), F.col(p).alias("__p"))
    many_rows = crowded(pairs, by, most)
    heads = quantiles(pairs, by, {"__mid": (F.col("__y"), 0.5), "__m": (F.abs("__y"), 0.5)}, many_rows, (F.min("__y").alias("__least"),))
    scale = F.lit(relative) if relative is not None else (F.col("__least") >= 0) & (F.col("__mid") > 0)
    heads = heads.withColumn("relative", scale).withColumn("floor", F.when(F.col("relative"), F.greatest(0.1 * F.col("__m"), F.lit(1e-6))).otherwise(1.0)).drop("__m", "__mid", "__least")
    both = pairs.join(heads, by) if by else pairs.join(F.broadcast(heads))  # one row
    resid = (F.col("__y") - F.col("__p")) / F.when(F.col("relative"), F.greatest(F.abs("__p"), F.col("floor"))).otherwise(1.0)
    shares = {"__lo": (F.col("__r"), (1 - level) / 2), "__hi": (F.col("__r"), 1 - (1 - level) / 2), "__w": (F.abs("__r"), level)}
    tails = quantiles(both.withColumn("__r", resid), [*by, "relative", "floor"], shares, many_rows, (F.count("*").alias("n"),))
    many = F.col("n") >= 20
    enough = F.col("n") >= 4
    return tails.select(*by, F.when(enough, F.when(many, F.col("__lo")).otherwise(-F.col("__w"))).alias("lo"), F.when(enough, F.when(many, F.col("__hi")).otherwise(F.col("__w"))).alias("hi"), "relative", "floor", "n")


def apply_band(rows: DataFrame, band: DataFrame, by: list[str] | None = None, p: str = "prediction", nonnegative: Column | bool = False) -> DataFrame:
    """``rows`` with ``lower`` and ``upper``; null where there is no band."""
    fitted = band.select(*(by or []), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("relative").alias("__rel"), F.col("floor").alias("__floor"))
    both = rows.join(fitted, by, "left") if by else rows.join(F.broadcast(fitted), how="left")  # one row
    scale = F.when(F.col("__rel"), F.greatest(F.abs(F.col(p)), F.col("__floor"))).otherwise(1.0)
    low = F.col(p) + F.col("__lo") * scale
    keep = nonnegative if isinstance(nonnegative, Column) else F.lit(nonnegative)
    return both.withColumn("lower", F.when(keep, F.when(low.isNotNull(), F.greatest(low, F.lit(0.0)))).otherwise(low)).withColumn("upper", F.col(p) + F.col("__hi") * scale).drop("__lo", "__hi", "__rel", "__floor")


def coverage(y: Column, low: Column, high: Column) -> Column:
    seen = known(y) & known(low) & known(high)
    return F.avg(F.when(seen, F.when((y >= low) & (y <= high), 1.0).otherwise(0.0)))


def band_width(low: Column, high: Column) -> Column:
    return F.median(high - low)


def spread(y: Column) -> Column:
    """Aggregate: the target's own range between its tenth and ninetieth percentile."""
    return F.percentile(y, 0.9) - F.percentile(y, 0.1)


def band_facts(banded: DataFrame, by: list[str], *extra: Column, y: str = "actual", most: int = CROWD) -> DataFrame:
    """``by...``, the aggregates ``extra``, and ``width`` and ``spread``: ``band_width`` and ``spread`` of groups of any size."""
    value = F.col(y)
    wanted = {"width": (F.col("upper") - F.col("lower"), 0.5), "__low": (value, 0.1), "__high": (value, 0.9)}
    found = quantiles(banded, by, wanted, crowded(banded, by, most), extra)
    return found.withColumn("spread", F.col("__high") - F.col("__low")).drop("__low", "__high")


def group_median(train: DataFrame, test: DataFrame, key: str, y: str, out: str = "baseline", most: int = CROWD) -> DataFrame:
    """``test`` with each row's group median of the training rows; unseen groups get the overall one."""
    seen = train.where(known(F.col(y)))
    medians = quantiles(seen, [key], {"__median": (F.col(y), 0.5)}, crowded(seen, [key], most))
    overall = quantiles(seen, [], {"__overall": (F.col(y), 0.5)}, crowded(seen, [], most))  # one row
    joined = test.join(medians.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left").join(F.broadcast(overall))
    return joined.withColumn(out, F.coalesce("__median", "__overall")).drop("__key", "__median", "__overall")


def best_dimension(train: DataFrame, val: DataFrame, dims: list[str], y: str) -> DataFrame:
    """``dimension, error`` of every dimension's group-median baseline on validation, the best first."""
    parts = [group_median(train, val, d, y).agg(wape(F.col(y), F.col("baseline")).alias("error")).withColumn("dimension", F.lit(d)) for d in dims]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("dimension", "error").orderBy("error", "dimension")


def class_prior(rows: DataFrame, label: str) -> DataFrame:
    """``label, share``, aligned by the label's name."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("label", (F.col("n") / F.col("total")).alias("share"))


def contributions(rows: DataFrame, period: Column, y: str = "actual", p: str = "prediction") -> DataFrame:
    """``period, loss``: each period's part of the total relative error; they sum to the fitness."""
    seen = rows.where(known(F.col(y)))
    total = seen.agg(F.sum(F.abs(F.col(y))).alias("total"))  # one row
    parts = seen.groupBy(period.alias("period")).agg(F.sum(F.abs(F.col(y) - F.col(p))).alias("loss"))
    return parts.join(F.broadcast(total)).select("period", (F.col("loss") / F.nullif("total", F.lit(0.0))).alias("loss"))


def significant_gain(new: DataFrame, best: DataFrame) -> DataFrame:
    """One row ``gain, significant`` from paired contributions per period."""
    d = best.select("period", F.col("loss").alias("b")).join(new.select("period", F.col("loss").alias("a")), "period").select((F.col("b") - F.col("a")).alias("d"))
    gain, noise = F.sum("d"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)) * F.sqrt(F.count("*").cast("double"))
    return d.agg(gain.alias("gain"), (gain > noise).alias("significant"))


def judge(model_error: float | None, baseline_error: float | None, band_coverage: float | None, test_rows: int, test_steps: int | None = None, needs_band: bool = True, width: float | None = None, own_spread: float | None = None) -> dict:
    """The verdict on the untouched test rows, each failed check with its numbers."""
    low, high = COVERAGE_RANGE
    ratio = model_error / baseline_error if model_error is not None and baseline_error else float("inf")
    found = {BEATS: (ratio <= BASELINE_RATIO, f"error ratio {ratio:.2f} of at most {BASELINE_RATIO}")}
    if needs_band:
        found[CALIBRATED] = (band_coverage is not None and low <= band_coverage <= high, f"covered {'nothing' if band_coverage is None else format(band_coverage, '.0%')}, {low:.0%} to {high:.0%} wanted")
    if needs_band and None not in (width, own_spread):
        found[SHARP] = (width < own_spread, f"width {width:.3g} against a spread of {own_spread:.3g}")
    found[ENOUGH] = (test_rows >= MIN_TEST_ROWS and (test_steps is None or test_steps >= MIN_TEST_STEPS), f"{test_rows} rows, {test_steps if test_steps is not None else 'any'} steps")
    failed = [name for name, (passed, _) in found.items() if not passed]
    return {"trusted": not failed, "failed": failed, "checks": [{"check": name, "passed": bool(passed), "detail": detail} for name, (passed, detail) in found.items()]}
