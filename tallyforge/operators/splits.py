"""Time-ordered splits that training may not look past, and deterministic splits by key."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import drawn
from tallyforge.sources.shared import with_places
from tallyforge.spec import ANCHOR, LOWER, STEP, UPPER

# Weeks for cases to resolve, and of validation and test; least steps of test, validation, training.
MATURITY_WEEKS, VAL_WEEKS, TEST_WEEKS = 26, 13, 13
TEST_STEPS, VAL_STEPS, TRAIN_STEPS = 13, 26, 26


class SplitError(ValueError):
    """A history too short for the cuts, or a split that would be redrawn."""


@dataclass(frozen=True)
class RowCuts:
    val_start: dt.date
    test_start: dt.date
    test_end: dt.date
    as_of: dt.date


def row_cuts(rows: DataFrame, as_of: dt.date, maturity_weeks: int = MATURITY_WEEKS, val_weeks: int = VAL_WEEKS, test_weeks: int = TEST_WEEKS) -> RowCuts:
    """Test ends ``maturity_weeks`` before the export, validation lies before it, training is the rest."""
    test_end = as_of - dt.timedelta(weeks=maturity_weeks)
    test_start = test_end - dt.timedelta(weeks=test_weeks)
    val_start = test_start - dt.timedelta(weeks=val_weeks)
    first = rows.agg(F.min(ANCHOR)).first()[0]
    if first is None or first >= val_start:
        raise SplitError(f"no rows before {val_start} to train on")
    return RowCuts(val_start, test_start, test_end, as_of)


def split_of(anchor: Column, cuts: RowCuts) -> Column:
    """``train``, ``val``, ``test``, or null for rows too young to be judged."""
    day = F.to_date(anchor)
    return F.when(day < F.lit(cuts.val_start), "train").when(day < F.lit(cuts.test_start), "val").when(day < F.lit(cuts.test_end), "test")


def labels_as_of(rows: DataFrame, cut: dt.date, unit_days: float) -> DataFrame:
    """Bounds as an export at ``cut`` would have shown them: rows resolved later are open again with what they had
    waited, rows created later have none."""
    waited = F.datediff(F.lit(cut), F.col(ANCHOR)) / unit_days
    finite = F.col(UPPER).isNotNull() & (F.abs(F.col(UPPER)) != float("inf")) & ~F.isnan(UPPER)
    resolved = F.coalesce(finite & (F.col(LOWER) <= waited), F.lit(False))
    low = F.when(resolved, F.col(LOWER)).otherwise(F.greatest(waited, F.lit(0.0)))
    high = F.when(resolved, F.col(UPPER)).otherwise(F.lit(float("inf")))
    return rows.withColumns({LOWER: F.when(waited >= 0, low), UPPER: F.when(waited >= 0, high)})


def series_cut_points(steps: int, horizon: int, min_train: int = TRAIN_STEPS) -> tuple[int, int]:
    """``(val_start, test_start)`` as places among the sorted distinct steps.

    Test and validation get their wanted lengths where training keeps its least one; a shorter history gives a
    third of what training leaves to test, a horizon at least, and the rest to validation.
    """
    judged = steps - min_train
    test = max(TEST_STEPS, horizon)
    wanted = test + max(VAL_STEPS, 2 * horizon)
    if judged >= wanted:
        return steps - wanted, steps - test
    if judged < 2 * horizon:
        raise SplitError(f"{steps} steps are too few: {min_train} to train on and {horizon} each to validate and test")
    return min_train, steps - max(judged // 3, horizon)


def series_cuts(panel: DataFrame, horizon: int, min_train: int = TRAIN_STEPS) -> DataFrame:
    """``__step, place, split`` for every distinct step; the window runs over distinct steps only."""
    steps = panel.select(STEP).distinct()
    val, test = series_cut_points(steps.count(), horizon, min_train)
    place = F.row_number().over(Window.orderBy(STEP)) - 1
    return steps.withColumn("place", place).withColumn("split", F.when(F.col("place") < val, "train").when(F.col("place") < test, "val").otherwise("test"))


def bucket_splits(frame: DataFrame, cuts: DataFrame) -> DataFrame:
    """A bucket's rows with ``split``: by their step where the target is known, ``future`` where it is to come."""
    marked = frame.join(cuts.select(F.col(STEP).alias("step"), F.col("split").alias("__split")), "step", "left")
    return marked.withColumn("split", F.when(F.col("future"), "future").when(F.col("y").isNotNull(), F.col("__split"))).drop("__split")


def parse_ratio(text: str) -> dict[str, int]:
    """``70/20/10`` as shares of train, val and test."""
    parts = text.split("/")
    if len(parts) != 3 or not all(p.strip().isdigit() for p in parts) or sum(map(int, parts)) == 0:
        raise SplitError(f"{text!r} is no ratio such as 70/20/10")
    return dict(zip(("train", "val", "test"), map(int, parts)))


def shares(total: int, ratio: dict[str, int]) -> dict[str, int]:
    """Whole counts by largest remainders; no part that was asked for stays empty while others can spare one."""
    whole = sum(ratio.values())
    counts = {k: total * v // whole for k, v in ratio.items()}
    by_rest = sorted(ratio, key=lambda k: -(total * ratio[k] % whole))
    for k in by_rest[: total - sum(counts.values())]:
        counts[k] += 1
    for k, v in ratio.items():
        if v and not counts[k]:
            most = max(counts, key=counts.get)
            if counts[most] > 1:
                counts[most] -= 1
                counts[k] += 1
    return counts


def assign(keys: DataFrame, key: Column, ratio: dict[str, int], seed: int) -> DataFrame:
    """``key, split`` for the distinct keys, in the order of ``crc32("seed:key")`` and then the key.

    Keys are range-partitioned by that order and numbered by position, so no task holds all of them.
    """
    names = keys.select(key.cast("string").alias("key")).where("key IS NOT NULL").distinct()
    placed = with_places(names.withColumn("drawn", F.crc32(F.concat(F.lit(f"{seed}:"), "key"))), ["drawn", "key"], "place")
    counts = shares(placed.count(), ratio)
    train, val = counts["train"], counts["train"] + counts["val"]
    return placed.select("key", F.when(F.col("place") < train, "train").when(F.col("place") < val, "val").otherwise("test").alias("split"))


def stamp_split(rows: DataFrame, key: Column, ratio: dict[str, int], seed: int) -> DataFrame:
    """``rows`` with a ``split`` column; a set that has one already is refused."""
    if "split" in rows.columns and not rows.where("split IS NOT NULL").isEmpty():
        raise SplitError("the set is split already; a second draw would leak")
    parts = assign(rows, key, ratio, seed)
    return rows.drop("split").withColumn("key", key.cast("string")).join(parts, "key", "left").drop("key")


def sampled(rows: DataFrame, key: Column, percent: int, seed: int) -> DataFrame:
    """The same ``percent`` of keys on every run; all rows of a key stay or go together."""
    return rows.where(drawn(F.lit(str(seed)), key.cast("string")) % 100 < percent)
