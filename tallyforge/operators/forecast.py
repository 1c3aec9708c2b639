"""A forecast run: workspace, recipes and their score, the search, and the frozen winner's tables."""

from __future__ import annotations

import hashlib
import json
import math
import random
import statistics
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import boosting, evaluate, features, models, splits
from tallyforge.operators.profile import build_profile
from tallyforge.plans.prepare import as_date, panel, prepare_rows, scaffold
from tallyforge.sources.shared import written
from tallyforge.spec import ANCHOR, LOWER, ROW, STEP, UNIT_DAYS, PrepSpec

# The search's defaults.
POPULATION, ELITE, PLATEAU, TOURNAMENT, HALVING_ROWS, SAMPLE_PERCENT, RETRIES = 16, 3, 5, 3, 50_000, 20, 5


@dataclass(frozen=True)
class Recipe:
    """Which feature families, objective and settings a model has."""

    families: tuple[str, ...]
    objective: str
    depth: int = 4
    rounds: int = 60
    rate: float = 0.1

    def key(self) -> str:
        return hashlib.sha1(json.dumps([sorted(self.families), self.objective, self.depth, self.rounds, self.rate]).encode()).hexdigest()

    def size(self) -> int:
        return len(self.families)


@dataclass
class Workspace:
    """Frames with ``y``, ``split``, the period of each row and features, one per horizon bucket or one for rows."""

    spec: PrepSpec
    frames: dict[str, DataFrame]
    families: dict[str, dict[str, str]]
    profile: dict
    period: str
    step: str | None = None
    cuts: object = None

    def release(self) -> None:
        """Gives the frames' memory back, once no table of this run is read any more."""
        for frame in self.frames.values():
            frame.unpersist()


def row_workspace(source: DataFrame, spec: PrepSpec, as_of: str | None = None, **cut_weeks) -> Workspace:
    """Rows with features, splits and, per split, the bounds an export at its cut would have shown."""
    rows, _ = prepare_rows(source, spec)
    latest = as_date(as_of or (spec.censor.as_of if spec.censor and spec.censor.as_of else None) or rows.agg(F.max(ANCHOR)).first()[0])
    cuts = splits.row_cuts(rows, latest, **cut_weeks)
    target = spec.with_role("target")[0]
    marked = rows.withColumn("split", splits.split_of(F.col(ANCHOR), cuts)).withColumnRenamed(target, "y")
    profile_spec = spec
    train = marked.where("split = 'train'").withColumnRenamed("y", target)
    profile = build_profile(splits.labels_as_of(train, cuts.val_start, UNIT_DAYS[spec.censor.unit]) if spec.censor else train, profile_spec)
    framed, families = features.row_features(marked, F.col("split") == "train", spec, [ROW, ANCHOR, "y", LOWER, "__upper", "split"])
    return Workspace(spec, {"all": framed.withColumn("period", F.date_trunc("week", ANCHOR).cast("date")).cache()}, {"all": families}, profile, "week", cuts=cuts)


def series_workspace(source: DataFrame, spec: PrepSpec, step: str, with_ewm: bool = True) -> Workspace:
    """One frame per horizon bucket, split by the steps' places in time."""
    grid, ahead = written(panel(source, spec, step)), written(scaffold(source, spec, step))  # read for every bucket and profile; the source is read twice
    cuts = splits.series_cuts(grid, spec.horizon)
    train_steps = cuts.where("split = 'train'").agg(F.max(STEP)).first()[0]
    in_train = F.col(STEP) <= F.lit(train_steps)
    profile = build_profile(grid.where(in_train), spec)
    frames, families = {}, {}
    for lo, hi in features.buckets_for(spec.horizon):
        frame, own = features.series_features(grid, ahead, spec, (lo, hi), step, in_train, profile["genes"]["period"], profile["genes"]["measure_lags"], with_ewm)
        name = f"{lo}-{hi}"
        frames[name] = written(splits.bucket_splits(frame, cuts).withColumn("period", F.col("step")))  # every recipe fits on it
        families[name] = own
    return Workspace(spec, frames, families, profile, step, step, cuts)


def families_of(ws: Workspace) -> list[str]:
    """Families that every frame has and that no leak spoils."""
    out = set.intersection(*[set(f.values()) for f in ws.families.values()])
    return sorted(f for f in out if f.split(":")[-1] not in ws.profile["leaks"])


def phase(ws: Workspace, recipe: Recipe, learn: tuple[str, ...], judged: str, percent: int = 100) -> DataFrame:
    """Predictions for one split by a model that learnt from earlier ones, all buckets together."""
    out = None
    for name, frame in ws.frames.items():
        wanted = features.picked(ws.families[name], set(recipe.families))
        train = frame.where(F.col("split").isin(*learn))
        if ws.spec.mode == "row" and ws.spec.censor:
            cut = ws.cuts.val_start if learn == ("train",) else ws.cuts.test_start
            train = splits.labels_as_of(train, cut, UNIT_DAYS[ws.spec.censor.unit])
            train = train.withColumn("y", F.when(F.col(LOWER) == F.col("__upper"), F.col(LOWER)))
        if percent < 100:
            train = splits.sampled(train, F.col("series" if ws.spec.mode == "series" else ROW), percent, 1)
        order = "step" if ws.spec.mode == "series" else ANCHOR
        fitted = models.fit_model(train, recipe.objective, wanted, order=order, depth=recipe.depth, rounds=recipe.rounds, rate=recipe.rate)
        part = models.predict(fitted, frame.where(F.col("split") == judged)).withColumn("bucket", F.lit(name))
        keys = ["series", "step"] if ws.spec.mode == "series" else [ROW, ANCHOR, LOWER]
        extra = ["class", "probability"] if ws.spec.task == "classification" else ["prediction"]
        part = part.select(*keys, "bucket", "period", F.col("y").alias("actual"), *extra)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Entry:
    recipe: Recipe
    fitness: float
    losses: dict = field(default_factory=dict)  # each period's part of the fitness
    sampled: bool = False

    def rank(self):
        return self.fitness, self.recipe.size(), self.recipe.key()


def score(ws: Workspace, recipe: Recipe, percent: int = 100) -> Entry:
    """A recipe's fitness: its relative error on validation (share of wrong classes for a class target), with each
    period's part of it. One row a period of the validation span comes back."""
    try:
        judged = phase(ws, recipe, ("train",), "val", percent)
        if ws.spec.task == "classification":
            judged = judged.select("period", F.lit(1.0).alias("actual"), F.when(F.col("class") == F.col("actual"), 1.0).otherwise(0.0).alias("prediction"))
        losses = {r["period"]: r["loss"] for r in evaluate.contributions(judged, F.col("period")).collect() if r["loss"] is not None}
    except models.FitError:
        losses = {}
    return Entry(recipe, sum(losses.values()) if losses else float("inf"), losses, sampled=percent < 100)


def packed_frame(ws: Workspace, name: str, percent: int = 100) -> tuple[DataFrame, list[str]]:
    """One row that holds what recipes learn from and are judged by in one frame, or in a share of its keys; and its columns.

    It is small: the caller sees to it that there are HALVING_ROWS training rows at most. Columns are binned, a byte a value.
    """
    frame, columns = ws.frames[name], list(ws.families[name])
    series, classes = ws.spec.mode == "series", ws.spec.task == "classification"
    train, judged = frame.where("split = 'train'"), frame.where("split = 'val'")
    if not series and ws.spec.censor:
        train = splits.labels_as_of(train, ws.cuts.val_start, UNIT_DAYS[ws.spec.censor.unit])
        train = train.withColumn("y", F.when(F.col(LOWER) == F.col("__upper"), F.col(LOWER)))
    if percent < 100:
        train, judged = (splits.sampled(x, F.col("series" if series else ROW), percent, 1) for x in (train, judged))
    edges = boosting.bin_edges(train, columns)
    y = F.col("y")
    if classes:
        kinds = train.agg(F.array_sort(F.collect_set(y.cast("string")))).first()[0]
        y = F.array_position(F.lit(kinds), y.cast("string")) - 1
    waits = not series and not classes
    facts = {
        "y": y, "t": F.col(LOWER) if waits else F.lit(None), "seen": (F.coalesce(F.col(LOWER) == F.col("__upper"), F.lit(False)) if waits else F.lit(True)).cast("int"),
        "order": F.unix_date(F.col("step" if series else ANCHOR).cast("date")), "period": F.unix_date(F.col("period").cast("date")),
    }
    part = lambda rows, own: rows.select(*[boosting._number(c).alias(f"x{i}") for i, c in enumerate(columns)], *[v.cast("double").alias(f"__{n}") for n, v in facts.items()], F.lit(float(own)).alias("__own"))

    names = ["bucket", "bins", *facts, "own"]

    def pack(batches):
        table = pa.Table.from_batches(list(batches))
        values = [np.asarray(c.cast(pa.float64()).fill_null(float("nan"))) for c in table.columns]
        x = np.stack(values[: len(edges)], axis=1)
        parts = [boosting.binned(x, edges).tobytes(), *(v.tobytes() for v in values[len(edges) :])]
        yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([p], pa.binary()) for p in parts)], names)

    rows = part(train, 1).unionByName(part(judged, 0))
    order = [c for c in rows.columns if c.startswith("__")]
    return written(rows.repartition(1).sortWithinPartitions(*order).mapInArrow(pack, "bucket string, " + ", ".join(f"{n} binary" for n in names[1:]))), columns


def _fitted_local(values: dict, bins: np.ndarray, objective: str, depth: int, rounds: int, rate: float):
    """``(period, error, weight)`` of the judged rows by one recipe, fitted on the rows that are to learn from; None where it can't be."""
    own, y, seen = values["own"] == 1, values["y"], values["seen"] == 1
    labels = objective in ("logistic", "softprob")
    target = values["t"] if objective == "aft" else y
    learn = own & np.isfinite(target) & ((target > 0) if objective == "aft" else (target >= 0) if labels else True)
    if learn.sum() < models.MIN_ROWS or objective in ("tweedie", "poisson") and target[learn].min() < 0:
        return None
    many = int(y[learn].max()) + 1 if labels else 1
    if labels:
        objective = "logistic" if many == 2 else "softprob"
    order = values["order"][learn]
    newest, t = order > np.percentile(order, 100 * models.NEWEST), target[learn]
    base, width = boosting.start_of(objective, t, many)
    model = boosting.fit_local(bins[learn], boosting.Settings(objective, depth, rounds, rate), t, seen[learn] if objective == "aft" else np.ones(len(t), dtype=bool), newest, base, width)
    judged = ~own & np.isfinite(y)
    said = boosting.output(objective, model.scores_of(bins[judged]))
    error, weight = (said.argmax(axis=1) != y[judged], np.ones(judged.sum())) if labels else (np.abs(said[:, 0] - y[judged]), np.abs(y[judged]))
    periods, at = np.unique(values["period"][judged].astype(np.int64), return_inverse=True)
    return periods, np.bincount(at, error, len(periods)), np.bincount(at, weight, len(periods))


def generation(frames: list[tuple[DataFrame, list[str]]], ws: Workspace, recipes: list[Recipe], sampled: bool) -> list[Entry]:
    """The entries of many recipes from one stage: a task for each recipe and frame fits and scores it on the packed rows."""
    spark = frames[0][0].sparkSession
    columns = {name: own for name, (_, own) in zip(ws.frames, frames)}
    rows = [(i, name, r.objective, r.depth, r.rounds, r.rate, [columns[name].index(c) for c in features.picked(ws.families[name], set(r.families))]) for i, r in enumerate(recipes) for name in ws.frames]
    wanted = spark.createDataFrame(rows, "recipe int, bucket string, objective string, depth int, rounds int, rate double, columns array<int>")
    packed = frames[0][0]
    for more, _ in frames[1:]:
        packed = packed.union(more)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = {n: np.frombuffer(row[n], np.float64) for n in ("y", "t", "seen", "order", "period", "own")}
                bins = np.frombuffer(row["bins"], np.uint8).reshape(len(values["y"]), -1)[:, row["columns"]]
                found = _fitted_local(values, bins, row["objective"], row["depth"], row["rounds"], row["rate"])
                periods, error, weight = found or ([None], [0.0], [0.0])
                yield pa.RecordBatch.from_arrays([pa.array([row["recipe"]] * len(periods), pa.int32()), pa.array(periods, pa.int64()), pa.array(error, pa.float64()), pa.array(weight, pa.float64())], ["recipe", "period", "error", "weight"])

    dealt = wanted.repartition(len(rows), "recipe", "bucket").join(F.broadcast(packed), "bucket")  # HALVING_ROWS rows, a byte a value
    scored = dealt.mapInArrow(run, "recipe int, period long, error double, weight double")
    losses: list[dict] = [{} for _ in recipes]
    weights, failed = [0.0] * len(recipes), set()
    for r in scored.groupBy("recipe", "period").agg(F.sum("error").alias("error"), F.sum("weight").alias("weight")).orderBy("recipe", "period").collect():  # a row for each recipe and period
        if r["period"] is None:
            failed.add(r["recipe"])
        else:
            losses[r["recipe"]][r["period"]] = r["error"]
            weights[r["recipe"]] += r["weight"]
    out = []
    for i, recipe in enumerate(recipes):
        own = {p: e / weights[i] for p, e in losses[i].items()} if weights[i] and i not in failed else {}
        out.append(Entry(recipe, float(f"{sum(own.values()):.9g}") if own else float("inf"), own, sampled))
    return out


def batch_scorer(ws: Workspace):
    """Scores a generation at a time: on packed rows where there are HALVING_ROWS of them at most, or of a sample that has
    no more; else recipe by recipe on all rows."""
    kept: dict[int, list] = {}
    most = max(1, min(SAMPLE_PERCENT, int(100 * HALVING_ROWS * SAMPLE_PERCENT / 100 / max(1, ws.profile["rows"]))))

    def scored(recipes: list[Recipe], percent: int) -> list[Entry]:
        if percent == 100 and ws.profile["rows"] > HALVING_ROWS:
            with ThreadPoolExecutor(2) as pool:
                return list(pool.map(lambda r: score(ws, r), recipes))
        share = 100 if percent == 100 else most
        if share not in kept:
            kept[share] = [packed_frame(ws, name, share) for name in ws.frames]
        return generation(kept[share], ws, recipes, percent < 100)

    return scored


@dataclass
class Budget:
    """Bounds of a search: generations without a gain, seconds, candidates at a time."""

    population: int = POPULATION
    generations: int = 60
    plateau: int = PLATEAU
    seconds: float = 1200.0
    threads: int = 2


@dataclass
class Board:
    entries: list[Entry] = field(default_factory=list)
    generations: int = 0
    stopped: str = ""


def gained(new: Entry, best: Entry | None) -> bool:
    """Whether ``new`` is better than ``best`` by more than the noise of their losses, period by period.

    The same rule as ``evaluate.significant_gain``, on the few periods that both entries carry.
    """
    if best is None or not math.isfinite(best.fitness):
        return math.isfinite(new.fitness)
    if new.fitness >= best.fitness or not new.losses or not best.losses:
        return False
    parts = [best.losses[p] - new.losses[p] for p in best.losses.keys() & new.losses.keys()]
    return len(parts) < 2 or sum(parts) > statistics.stdev(parts) * len(parts) ** 0.5


def _mutated(recipe: Recipe, families: list[str], objectives: list[str], rng: random.Random) -> Recipe:
    own = set(recipe.families) ^ {rng.choice(families)} or {rng.choice(families)}
    objective = rng.choice(objectives) if rng.random() < 0.2 else recipe.objective
    return Recipe(tuple(sorted(own)), objective, rng.choice((2, 3, 4, 5)) if rng.random() < 0.3 else recipe.depth, rng.choice((5, 10, 20)) if rng.random() < 0.3 else recipe.rounds, rng.choice((0.05, 0.1, 0.3)) if rng.random() < 0.3 else recipe.rate)


def _crossed(a: Recipe, b: Recipe, rng: random.Random) -> Recipe:
    own = {f for f in {*a.families, *b.families} if rng.random() < 0.5} or set(a.families)
    pick = lambda x, y: rng.choice((x, y))
    return Recipe(tuple(sorted(own)), pick(a.objective, b.objective), pick(a.depth, b.depth), pick(a.rounds, b.rounds), pick(a.rate, b.rate))


def search(ws: Workspace, budget: Budget | None = None, warm: list[Recipe] = (), seed: int = 7, on_event=None, stop=None, scorer=None) -> Board:
    """A genetic search over recipes; a generation is fitted and scored in one stage, the bookkeeping is a few dozen recipes.

    Scores are remembered by recipe and by whether they came from a sample; one from all rows serves where a sample's
    would do. Above ``HALVING_ROWS`` training rows candidates are first scored on a sample of keys and the best third
    anew on all rows. ``scorer(ws, recipe, percent)`` takes the place of the batch's.
    """
    budget, rng, began = budget or Budget(), random.Random(seed), time.monotonic()
    families, objectives = families_of(ws), ws.profile["genes"]["objectives"]
    halve = ws.profile["rows"] > HALVING_ROWS
    known: dict[tuple[str, bool], Entry] = {}
    board, stale = Board(), 0
    together = batch_scorer(ws) if scorer is None else None
    population = list(warm)[: budget.population]
    while len(population) < budget.population:
        size = rng.randint(1, max(1, len(families) // 2))
        population.append(Recipe(tuple(sorted(rng.sample(families, size))), objectives[len(population) % len(objectives)]))

    def scored(recipes, percent):
        wanted = {(r.key(), percent < 100 and (r.key(), False) not in known): r for r in recipes}
        new = {k: r for k, r in wanted.items() if k not in known}
        if new and scorer is None:
            known.update(zip(new, together(list(new.values()), percent)))
        elif new:
            with ThreadPoolExecutor(budget.threads) as pool:
                for k, entry in zip(new, pool.map(lambda r: scorer(ws, r, percent), new.values())):
                    known[k] = entry
        return [known[k] for k in wanted]

    while board.generations < budget.generations:
        entries = sorted(scored(population, SAMPLE_PERCENT if halve else 100), key=Entry.rank)
        if halve:
            entries = sorted(scored([e.recipe for e in entries[: max(1, len(entries) // 3)]], 100), key=Entry.rank)
        best = board.entries[0] if board.entries else None
        merged = {e.recipe.key(): e for e in [*board.entries, *entries]}
        board.entries = sorted(merged.values(), key=Entry.rank)[:25]
        board.generations += 1
        if on_event:
            on_event(board)
        stale = 0 if gained(board.entries[0], best) else stale + 1
        for reason, hit in (("stopped", stop and stop()), ("plateau", stale >= budget.plateau), ("time", time.monotonic() - began > budget.seconds)):
            if hit:
                board.stopped = reason
                return board
        elite = [e.recipe for e in board.entries[:ELITE]]
        children = list(elite)
        while len(children) < budget.population:
            a, b = (min(rng.sample(entries, min(TOURNAMENT, len(entries))), key=Entry.rank).recipe for _ in range(2))
            child = _mutated(_crossed(a, b, rng), families, objectives, rng)
            for _ in range(RETRIES):  # a recipe that is there already teaches nothing
                if child.key() not in {c.key() for c in children} and (child.key(), halve) not in known:
                    break
                child = _mutated(child, families, objectives, rng)
            children.append(child)
        population = children
    board.stopped = "generations"
    return board


BOARD = "families array<string>, objective string, depth int, rounds int, rate double, fitness double"


def save_board(spark: SparkSession, board: Board, path: str) -> None:
    """The board's recipes with their fitness, best first."""
    rows = [(list(e.recipe.families), e.recipe.objective, e.recipe.depth, e.recipe.rounds, e.recipe.rate, e.fitness) for e in board.entries]
    spark.createDataFrame(rows, BOARD).coalesce(1).write.mode("overwrite").json(path)


def saved_recipes(spark: SparkSession, path: str, top: int = 25) -> list[Recipe]:
    """Recipes of an earlier board, to start a search from or to fit anew."""
    rows = spark.read.schema(BOARD).json(path).orderBy("fitness", F.size("families")).limit(top).collect()
    return [Recipe(tuple(r["families"]), r["objective"], r["depth"], r["rounds"], r["rate"]) for r in rows]


def ahead_of(ws: Workspace, recipe: Recipe) -> DataFrame:
    """What is to come, by models that learnt from all rows that are known."""
    out, series = None, ws.spec.mode == "series"
    for name, frame in ws.frames.items():
        wanted = features.picked(ws.families[name], set(recipe.families))
        known_rows = frame.where("split IN ('train', 'val', 'test')" if series else "y IS NOT NULL")
        fitted = models.fit_model(known_rows, recipe.objective, wanted, order="step" if series else ANCHOR, depth=recipe.depth, rounds=recipe.rounds, rate=recipe.rate)
        if series:
            part = models.predict(fitted, frame.where("future")).select("series", "step", F.lit(name).alias("bucket"), "prediction")
        else:
            unit = UNIT_DAYS[ws.spec.censor.unit] if ws.spec.censor else 7.0
            part = models.predict(fitted, frame.where("y IS NULL")).select(F.col(ROW).alias("row"), F.col(ANCHOR).alias("anchor"), F.lit(name).alias("bucket"), "prediction")
            part = part.withColumn("predicted_date", models.predicted_date(F.col("anchor"), F.col("prediction"), unit))
        out = part if out is None else out.unionByName(part)
    return out


def finish(ws: Workspace, recipe: Recipe) -> dict:
    """The frozen winner: validation and test predictions, bands, forecast and verdict; test rows are read here only."""
    by = ["bucket"]
    with ThreadPoolExecutor(3) as pool:  # three fits that do not wait for one another
        parts = [pool.submit(phase, ws, recipe, *span) for span in ((("train",), "val"), (("train", "val"), "test"))]
        parts += [pool.submit(ahead_of, ws, recipe)] if ws.spec.task != "classification" else []
        validation, test, *rest = (evaluate.stored(p.result()) for p in parts)  # read several times
    if ws.spec.task == "classification":
        error = test.agg(F.avg(F.when(F.col("class") == F.col("actual"), 0.0).otherwise(1.0)).alias("e"), F.count("*").alias("n")).first()
        prior = evaluate.class_prior(ws.frames["all"].where("split IN ('train', 'val')"), "y").agg(F.max("share")).first()[0]
        return {"validation": validation, "test": test, "verdict": evaluate.judge(error["e"], None if prior is None else 1 - prior, None, error["n"], needs_band=False)}
    band = evaluate.fit_band(validation, by)
    signed = validation.agg(F.min("actual") >= 0).first()[0] or False
    banded = evaluate.apply_band(test, band, by, nonnegative=bool(signed))
    y, p = F.col("actual"), F.col("prediction")
    row = banded.agg(evaluate.wape(y, p).alias("e"), evaluate.coverage(y, F.col("lower"), F.col("upper")).alias("c"), F.count(y).alias("n"), F.count_distinct("period").alias("steps")).first()
    spans = {"w": (F.col("upper") - F.col("lower"), 0.5), "low": (y, 0.1), "high": (y, 0.9)}
    wide = evaluate.quantiles(banded, [], spans, evaluate.crowded(banded, [])).first()
    own_spread = None if wide["low"] is None else wide["high"] - wide["low"]
    if ws.spec.mode == "series":
        last = [c for f in ws.families.values() for c in f]
        parts = None
        for name, frame in ws.frames.items():
            lag = next(c for c, fam in ws.families[name].items() if fam == ("season" if "season" in ws.families[name].values() else "lag+0"))
            own = frame.where("split = 'test'").select(F.col("y").alias("actual"), F.col(lag).alias("prediction"))
            parts = own if parts is None else parts.unionByName(own)
        baseline = parts.agg(evaluate.wape(y, p)).first()[0] if last else None
        steps = row["steps"]
    else:
        frame, steps = ws.frames["all"], None
        known_rows = frame.where("split IN ('train', 'val') AND y IS NOT NULL")
        overall = evaluate.quantiles(known_rows, [], {"m": (F.col("y"), 0.5)}, evaluate.crowded(known_rows, [])).first()["m"]
        baseline = test.withColumn("prediction", F.lit(overall)).agg(evaluate.wape(y, p)).first()[0]
    forecast = evaluate.apply_band(rest[0], band, by, nonnegative=bool(signed))
    return {"validation": validation, "test": test, "forecast": forecast, "verdict": evaluate.judge(row["e"], baseline, row["c"], row["n"], steps, width=wide["w"], own_spread=own_spread)}
