"""Preparation, splits, features and models by their invariants."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluate, features, forecast, models, profile, splits
from tallyforge.plans import prepare
from tallyforge.spec import Censor, Column, PrepSpec, SpecError, parse_spec

DAY = dt.date(2023, 7, 3)
SPEC = PrepSpec("series", (Column("day", "time"), Column("project", "dimension"), Column("orders", "measure", "last"), Column("units", "target", "sum")), step="week", horizon=8)


@pytest.fixture(scope="module")
def sales(spark):
    rng = random.Random(2)
    rows = []
    for p, weeks in (("A", 130), ("B", 130), ("C", 100)):
        for w in range(weeks):
            if p == "A" and 70 <= w <= 72:
                continue
            for d in (0, 3):
                rows.append((DAY + dt.timedelta(weeks=w, days=d), p, float(rng.randint(1, 9)), float(10 + w % 26 + rng.random())))
    rows.append((None, "A", 1.0, 1.0))
    return spark.createDataFrame(rows, "day date, project string, orders double, units double")


def test_spec_refusals():
    for bad in (dict(mode="x"), dict(task="y"), dict(step="decade"), dict(horizon=0), dict(columns=[]), dict(odd=1)):
        with pytest.raises(SpecError):
            parse_spec({"mode": "series", "columns": [dict(name="t", role="time"), dict(name="y", role="target")]} | bad)
    with pytest.raises(SpecError):
        Column("a", "target", "median")
    assert SPEC.key() == parse_spec({"mode": "series", "columns": list(SPEC.columns), "step": "week", "horizon": 8}).key()
    assert PrepSpec("row", (Column("a", "anchor"), Column("m", "measure", known=False), Column("n", "measure"), Column("y", "target"))).predictors() == ["n"]


def test_panel_has_no_gaps_and_fills_by_rule(sales):
    grid = prepare.panel(sales, SPEC)
    rows = {(r["__series"], r["__step"]): r for r in grid.collect()}
    assert len(rows) == 130 + 130 + 100
    hole = rows[("A", DAY + dt.timedelta(weeks=71))]
    assert hole["units"] == 0.0 and hole["orders"] == rows[("A", DAY + dt.timedelta(weeks=69))]["orders"]
    assert all(k[1].weekday() == 0 for k in rows)
    assert prepare.scaffold(sales, SPEC).count() == 3 * 8
    summary = prepare.series_summary(sales, SPEC).first()
    assert (summary["dropped_null_time"], summary["series"], summary["panel_rows"]) == (1, 3, 360)


def test_nulls_in_dimensions(spark):
    rows = spark.createDataFrame([(DAY, "A", None, 1.0), (DAY, None, "A", 2.0), (DAY, None, None, None)], "day date, x string, y string, v double")
    spec = PrepSpec("series", (Column("day", "time"), Column("x", "dimension"), Column("y", "dimension"), Column("v", "target", "sum")), step="day")
    assert {r["__series"] for r in prepare.grouped_steps(rows, spec, "day").collect()} == {"A", ""}


def test_rows_relabelled_at_a_cut(spark):
    anchors = [DAY, DAY + dt.timedelta(weeks=2), DAY + dt.timedelta(weeks=9)]
    rows = spark.createDataFrame([(i, a, low, up) for i, (a, low, up) in enumerate(zip(anchors, (3.0, 5.0, 1.0), (3.0, 5.0, float("inf"))))], "k int, __anchor date, __lower double, __upper double")
    seen = {r["k"]: (r["__lower"], r["__upper"]) for r in splits.labels_as_of(rows, DAY + dt.timedelta(weeks=4), 7.0).collect()}
    assert seen == {0: (3.0, 3.0), 1: (2.0, float("inf")), 2: (None, None)}


def test_cuts():
    assert splits.series_cut_points(130, 8) == (130 - 13 - 26, 130 - 13)
    assert splits.series_cut_points(60, 8) == (26, 49)
    with pytest.raises(splits.SplitError):
        splits.series_cut_points(30, 8)


def test_split_by_hash(spark):
    names = [f"{i:07d}.jpg" for i in range(200)]
    drawn = {r["key"]: r["split"] for r in splits.assign(spark.createDataFrame([(n,) for n in names + names[:5] + [None]], "frame string"), F.col("frame"), splits.parse_ratio("70/20/10"), 3).collect()}
    order = sorted(names, key=lambda n: (zlib.crc32(f"3:{n}".encode()), n))
    assert drawn == {n: "train" if i < 140 else "val" if i < 180 else "test" for i, n in enumerate(order)}
    assert splits.shares(3, {"train": 98, "val": 1, "test": 1}) == {"train": 1, "val": 1, "test": 1}
    with pytest.raises(splits.SplitError):
        splits.parse_ratio("70/20")
    table = spark.createDataFrame([("a", "train")], "frame string, split string")
    with pytest.raises(splits.SplitError):
        splits.stamp_split(table, F.col("frame"), {"train": 1, "val": 1, "test": 1}, 1)


def test_features_ignore_what_comes_after_the_origin(sales):
    """Changing the last weeks changes no feature of earlier origins."""
    cut = DAY + dt.timedelta(weeks=100)
    other = sales.withColumn("units", F.when(F.col("day") >= cut, 9999.0).otherwise(F.col("units")))

    def frame(source):
        grid, ahead = prepare.panel(source, SPEC), prepare.scaffold(source, SPEC)
        out, names = features.series_features(grid, ahead, SPEC, (2, 4), "week", F.col("__step") < F.lit(cut - dt.timedelta(weeks=10)), period=26, measure_lags={"orders": 6})
        seen = out.where(F.date_sub("step", 28) < F.lit(cut)).drop("y")
        return sorted(map(str, seen.collect())), names, out

    a, names, out = frame(sales)
    b, _, _ = frame(other)
    assert a == b and a
    assert {"lag+0", "season", "roll:4", "ewm:0.1", "lead:orders", "cal:month", "dim:project"} <= set(names.values())
    assert out.where("future").count() == 3 * 3
    assert features.buckets_for(8) == [(1, 1), (2, 4), (5, 8)] and features.buckets_for(60)[-1] == (53, 60)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_smoothing_over_parts_is_that_of_whole_series(spark, parts):
    """A series over many parts, short ones, gaps at the begin and within, a series without values: as along each series."""
    import pandas as pd

    rng = random.Random(parts)
    rows = []
    for series, n in (("a", 300), ("b", 5), ("c", 120), ("d", 9), ("e", 40)):
        for i in range(n):
            known = series != "d" and not (series == "c" and i < 70) and rng.random() > 0.2
            rows.append((series, DAY + dt.timedelta(days=i), rng.random() * 100 if known else None, series * 2))
    frame = spark.createDataFrame(rows, "__series string, __step date, units double, other string").repartition(4)
    found = features.smoothed(frame, "units", parts=parts).toPandas().sort_values(["__series", "__step"]).reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["__series", "__step", "units", "other"]).sort_values(["__series", "__step"]).reset_index(drop=True)
    assert len(found) == len(want)
    for a in features.ALPHAS:
        own = want.groupby("__series")["units"].transform(lambda x: x.ewm(alpha=a, adjust=False, ignore_na=True).mean())
        assert found[f"ewm{round(a * 100)}"].to_numpy() == pytest.approx(own.to_numpy(), nan_ok=True, rel=1e-9)
    assert features.smoothed(frame.where("false"), "units").count() == 0


def test_profile_reads_training_rows_only(sales):
    grid = prepare.panel(sales, SPEC)
    train = F.col("__step") < F.lit(DAY + dt.timedelta(weeks=80))
    a = profile.build_profile(grid.where(train), SPEC)
    b = profile.build_profile(grid.withColumn("units", F.when(train, F.col("units")).otherwise(0.0)).where(train), SPEC)
    assert a == b
    assert a["period"] in (26, 52) and a["genes"]["objectives"][:2] == ["squared", "absolute"]


def test_bands_and_verdict(spark):
    few = spark.createDataFrame([(float(i), float(i) + 1) for i in range(3)], "actual double, prediction double")
    assert evaluate.fit_band(few).first()["lo"] is None
    assert evaluate.apply_band(few, evaluate.fit_band(few)).where("lower IS NOT NULL").count() == 0
    rng = random.Random(1)
    many = spark.createDataFrame([(50 + rng.gauss(0, 5), 50.0) for _ in range(400)] + [(None, 50.0)], "actual double, prediction double")
    banded = evaluate.apply_band(many, evaluate.fit_band(many))
    assert banded.agg(evaluate.coverage(F.col("actual"), F.col("lower"), F.col("upper"))).first()[0] == pytest.approx(0.8, abs=0.02)
    good = evaluate.judge(1.0, 2.0, 0.8, 40, 20, width=1.0, own_spread=2.0)
    assert good["trusted"] and not good["failed"]
    assert evaluate.judge(1.9, 2.0, None, 10)["failed"] == ["beats the naive baseline", "band is calibrated", "enough history to judge"]


def test_models(spark, tmp_path):
    rng = random.Random(4)
    rows = spark.createDataFrame([(x := rng.random(), None if i % 9 == 0 else rng.random(), 10 * (x > 0.5) + rng.random(), "hi" if x > 0.5 else "lo", DAY + dt.timedelta(days=i)) for i in range(200)], "a double, b double, y double, label string, day date")
    fitted = models.fit_model(rows, "squared", ["a", "b"], order="day", depth=2, rounds=30, rate=0.3)
    error = models.predict(fitted, rows).agg(evaluate.wape(F.col("y"), F.col("prediction"))).first()[0]
    assert error < 0.15
    classes = models.fit_model(rows, "logistic", ["a", "b"], y="label", depth=2, rounds=3)
    out = models.predict(classes, rows)
    assert out.where("class = label").count() > 190
    models.save(classes, str(tmp_path / "m"))
    again = models.predict(models.load(str(tmp_path / "m")), rows)
    assert [r["class"] for r in again.orderBy("day").collect()] == [r["class"] for r in out.orderBy("day").collect()]
    with pytest.raises(models.FitError):
        models.fit_model(rows.limit(5), "squared", ["a"])
    with pytest.raises(models.FitError):
        models.fit_model(rows.withColumn("y", -F.col("y")), "poisson", ["a"])
    with pytest.raises(models.FitError):
        models.fit_model(rows, "guess", ["a"])


def test_estimators_by_name(spark, tmp_path):
    rows = spark.createDataFrame([({"a": float(i)}, "hi" if i > 30 else "lo") for i in range(60)], "features map<string,double>, label string")
    models.add_backend("shallow", lambda *wanted, **more: models.fit_model(*wanted, depth=1, rounds=8, rate=0.5, **more))
    fitted = models.fit_maps(rows, estimator="shallow")
    models.save(fitted, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert fitted.backend == again.backend == "shallow" and again.classes == ["hi", "lo"]
    assert models.predict_maps(again, rows).where("class = label").count() > 55
    with pytest.raises(models.FitError):
        models.fit_maps(rows, estimator="none")


def test_search_is_deterministic_and_stops(spark, tmp_path):
    families = {f"f{i}": f"f{i}" for i in range(6)}
    ws = forecast.Workspace(SPEC, {"1-1": None}, {"1-1": families}, {"leaks": {"f5": "constant gap"}, "rows": 10, "genes": {"objectives": ["squared", "absolute"]}}, "week")
    tries = []

    def scorer(ws, recipe, percent):
        tries.append(recipe.key())
        return forecast.Entry(recipe, abs(len(recipe.families) - 2) + (recipe.objective == "absolute") * 0.5)

    boards = [forecast.search(ws, forecast.Budget(population=6, generations=6, threads=1), seed=5, scorer=scorer) for _ in range(2)]
    assert [e.recipe for e in boards[0].entries] == [e.recipe for e in boards[1].entries]
    assert boards[0].entries == sorted(boards[0].entries, key=forecast.Entry.rank)
    assert not any("f5" in e.recipe.families for e in boards[0].entries)
    assert len(set(tries)) * 2 == len(tries)
    forecast.save_board(spark, boards[0], str(tmp_path / "board"))
    assert forecast.saved_recipes(spark, str(tmp_path / "board"), 1) == [boards[0].entries[0].recipe]
    warm = forecast.Recipe(("f0", "f1"), "squared")
    assert forecast.search(ws, forecast.Budget(population=4, generations=1, threads=1), [warm], scorer=scorer).entries[0].fitness == 0
    assert forecast.search(ws, forecast.Budget(population=4, generations=50, plateau=2, threads=1), scorer=scorer).stopped == "plateau"
    assert forecast.search(ws, forecast.Budget(population=4, threads=1), stop=lambda: True, scorer=scorer).stopped == "stopped"


def test_a_generation_in_one_stage_scores_as_each_recipe_alone(sales):
    """The same fitness from tasks on packed rows as from passes over the frames; a recipe that can't be fitted has none."""
    ws = forecast.series_workspace(sales, SPEC, "week")
    recipes = [forecast.Recipe(("lag+0", "lag+1", "roll:4"), "squared", 3, 6, 0.3), forecast.Recipe(("lag+0", "season", "dim:project"), "absolute", 2, 5, 0.3), forecast.Recipe(("lag+0",), "tweedie", 2, 4, 0.3)]
    together = forecast.batch_scorer(ws)(recipes, 100)
    for entry in together[:2]:
        alone = forecast.score(ws, entry.recipe)
        assert entry.fitness == pytest.approx(alone.fitness, rel=0.02) and len(entry.losses) == len(alone.losses)
    share = forecast.batch_scorer(ws)(recipes[:1], forecast.SAMPLE_PERCENT)[0]
    assert share.sampled and not together[0].sampled
    ws.release()


def test_boosting_of_waits_and_missing_values(spark, tmp_path):
    """Trees that know open cases expect them to wait on; missing values go to the side that suits them; a probe stops in time."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        x, wait = rng.random(), 4.0
        x, wait = (None, 12.0) if i % 5 == 0 else (x, 8.0 if x > 0.6 else 2.0)
        wait *= 0.9 + 0.2 * rng.random()
        cut = rng.random() * 10 if i % 2 else None
        rows.append((x, min(wait, cut) if cut else wait, None if cut and cut < wait else wait, wait, DAY + dt.timedelta(days=i)))
    frame = spark.createDataFrame(rows, "x double, __lower double, __upper double, truth double, day date").withColumn("y", F.when(F.col("__lower") == F.col("__upper"), F.col("__lower")))
    aware = models.fit_model(frame, "aft", ["x"], order="day", depth=2, rounds=200, rate=0.3, patience=5)
    naive = models.fit_model(frame, "absolute", ["x"], order="day", depth=2, rounds=40, rate=0.3)
    open_ = frame.where("__upper IS NULL")
    share = [models.predict(m, open_).agg(evaluate.open_consistency(F.col("prediction"), F.col("__lower"))).first()[0] for m in (aware, naive)]
    assert share[0] >= share[1] and share[0] > 0.9
    far = models.predict(aware, frame.where("x IS NULL")).agg(F.avg("prediction")).first()[0]
    assert 8 < far < 20 and aware.model.rounds < 200
    models.save(aware, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert models.predict(again, frame).agg(F.sum("prediction")).first()[0] == pytest.approx(models.predict(aware, frame).agg(F.sum("prediction")).first()[0])


def test_derivatives_are_those_of_the_losses():
    import numpy as np

    from tallyforge.operators import boosting

    rng = np.random.default_rng(1)
    y, seen = rng.random(50) * 5 + 0.1, rng.random(50) < 0.5
    for objective in ("squared", "tweedie", "poisson", "aft", "logistic", "softprob"):
        m = rng.normal(0, 1, (50, 3 if objective == "softprob" else 1))
        t = rng.integers(0, m.shape[1] if m.shape[1] > 1 else 2, 50) if objective in ("logistic", "softprob") else y
        g, h = boosting.derivatives(objective, m, t, seen, 1.0)
        for k in range(m.shape[1]):
            step = np.zeros(m.shape)
            step[:, k] = 1e-4
            slope = (boosting.losses(objective, m + step, t, seen) - boosting.losses(objective, m - step, t, seen)) / 2e-4
            bend = (boosting.derivatives(objective, m + step, t, seen, 1.0)[0][:, k] - boosting.derivatives(objective, m - step, t, seen, 1.0)[0][:, k]) / 2e-4
            assert slope == pytest.approx(g[:, k] * (2 if objective == "squared" else 1), abs=2e-3)
            assert bend * (2 if objective == "softprob" else 1) == pytest.approx(h[:, k], abs=2e-3)


def test_censored_rows_keep_open_cases(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        start = DAY + dt.timedelta(days=rng.randrange(700))
        wait = rng.choice((4, 8)) + rng.random()
        end = start + dt.timedelta(weeks=wait)
        rows.append((i, start, "slow" if wait > 8 else "fast", wait if end <= DAY + dt.timedelta(days=700) else None))
    spec = PrepSpec("row", (Column("start", "anchor"), Column("kind", "dimension"), Column("wait", "target")), censor=Censor("week"))
    source = spark.createDataFrame(rows, "__row long, start date, kind string, wait double")
    rows, ahead = prepare.prepare_rows(source, spec)
    assert rows.count() == 300 and ahead.count() == rows.where("wait IS NULL").count() > 0
    assert ahead.where("__upper < double('inf') OR __lower < 0").count() == 0
    with pytest.raises(splits.SplitError):
        splits.row_cuts(rows, DAY + dt.timedelta(days=100))


def test_quantiles_of_crowded_groups(spark):
    """Sorted over all tasks they are what one task makes of a group; ties, nulls and a group without a name count."""
    from tallyforge.operators.evaluate import fit_band, group_median, quantiles

    rows = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.floor(F.sqrt("id")) * 1.1).alias("v"), (F.col("id") % 13).cast("double").alias("w"))
    wanted = {"a": (F.col("v"), 0.1), "b": (F.col("v"), 0.5), "c": (F.col("w"), 0.9)}
    for by in (["g"], []):
        one, many = ({tuple(r.asDict().items()) for r in quantiles(rows, by, wanted, way, (F.count("*").alias("n"),)).collect()} for way in (False, True))
        assert one == many and len(one) == (4 if by else 1)
    pairs = rows.select("g", F.col("v").alias("actual"), F.col("w").alias("prediction"))
    for by in (["g"], []):
        one, many = (sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in fit_band(pairs, by, most=m).collect()) for m in (10**6, 10))
        assert one == many
    one, many = (sorted(map(str, group_median(rows, rows, "g", "v", most=m).collect())) for m in (10**6, 10))
    assert one == many
    empty = rows.where("false")
    assert quantiles(empty, ["g"], wanted, True).count() == 0 and quantiles(empty, [], wanted, True).first()["a"] is None


def test_running_totals(spark):
    from tallyforge.sources.shared import with_running

    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(100)).alias("k"), "id", (F.col("id") % 5).alias("n"))
    got = with_running(rows, ["k", "id"], "n", "before").orderBy("k", "id").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["n"]
    assert len(got) == 1000


def test_rows_alike_are_packed_as_one_with_a_weight(spark):
    """What a fit goes over again and again grows with the rows that differ, not with all; the trees are those of all rows."""
    import numpy as np

    from tallyforge.operators import boosting

    rows = spark.range(30_000).select((F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") % 4).cast("double").alias("b"))
    rows = rows.withColumn("y", 1 + F.col("a") * 3 + F.coalesce("b", F.lit(9.0)))
    kept = boosting.packed(rows, ["a", "b"], boosting.bin_edges(rows, ["a", "b"]), F.col("y"), F.lit(True), F.col("a") > 3).collect()
    assert sum(len(r["y"]) // 8 for r in kept) == 25 and sum(np.frombuffer(r["weight"]).sum() for r in kept) == 30_000
    fitted = models.fit_model(rows, "squared", ["a", "b"], depth=3, rounds=4, rate=0.5).model
    x = np.array([[np.nan if v is None else v for v in r] for r in rows.collect()])
    bins, every = boosting.binned(x[:, :2], fitted.edges), np.ones(len(x), dtype=bool)
    local = boosting.fit_local(bins, boosting.Settings("squared", 3, 4, 0.5), x[:, 2], every, ~every, fitted.base, 1.0)
    assert np.allclose(local.scores_of(bins), fitted.scores_of(bins), rtol=1e-8)


def test_series_frames_do_not_read_the_source_again(spark, sales, tmp_path):
    sales.write.parquet(f"{tmp_path}/source")
    ws = forecast.series_workspace(spark.read.parquet(f"{tmp_path}/source"), SPEC, "week", with_ewm=False)
    try:
        assert not any(f"{tmp_path}" in file for frame in ws.frames.values() for file in frame.inputFiles())
    finally:
        ws.release()


@pytest.mark.parametrize(("objective", "order"), [("squared", "day"), ("absolute", None), ("aft", "day"), ("softprob", None), ("logistic", None)])
def test_few_unlike_rows_are_fitted_in_one_task(spark, monkeypatch, objective, order):
    """A job for each level of a round only where rows are many; the trees are the same."""
    from tallyforge.operators import boosting

    rows = spark.range(4000).select((F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") % 4).cast("double").alias("b"), F.date_add(F.lit(DAY), (F.col("id") / 10).cast("int")).alias("day"))
    rows = rows.withColumn("wait", 1 + F.col("a") * 3 + F.coalesce("b", F.lit(9.0))).withColumns({"__lower": F.col("wait"), "__upper": F.when(F.col("a") < 4, F.col("wait"))})
    kinds = 2 if objective == "logistic" else 3
    rows = rows.withColumn("y", F.col("a").cast("int") % kinds if objective in ("softprob", "logistic") else F.col("wait")).cache()

    def fitted(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            return models.fit_model(rows, objective, ["a", "b"], order=order, depth=3, rounds=6, rate=0.4).model
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    one = fitted(f"one-{objective}")
    monkeypatch.setattr(boosting, "ONE_TASK", 0)
    many = fitted(f"many-{objective}")
    assert jobs(f"one-{objective}") < 18 <= jobs(f"many-{objective}")
    assert one.base == many.base and len(one.trees) == len(many.trees) > 0
    for a, b in zip(sum(one.trees, []), sum(many.trees, [])):
        assert (a.column == b.column).all() and (a.bin == b.bin).all() and (a.missing_left == b.missing_left).all()
        assert a.value == pytest.approx(b.value, rel=1e-7, abs=1e-12)
    rows.unpersist()


def test_series_frames_are_as_few_parts_as_their_rows_need(spark, sales):
    """A fit is dozens of jobs over each frame; a few hundred rows are not as many tasks as a shuffle has partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        ws = forecast.series_workspace(sales, SPEC, "week", with_ewm=False)
        assert all(frame.rdd.getNumPartitions() <= 8 for frame in ws.frames.values())
        ws.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sums_over_many_rows_keep_the_leaves_digits():
    """A leaf's value, added up over as many rows as there may be, is right to a tenth."""
    from tallyforge.operators import boosting

    n, g = 50_000_000, 1e9 / 3
    assert boosting._leaf(g, n, 0.5, 1.0) * n == pytest.approx(-0.5 * g / (n + 1) * n, abs=0.01)


def test_objectives_of_the_same_rows_share_the_passes_over_them(spark):
    """Rows are gone over once for all objectives that learn from them, not once for each; the models are those of fits apart."""
    rows = spark.range(4000).select((F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") % 4).cast("double").alias("b"))
    rows = rows.withColumn("y", 1 + F.col("a") * 3 + F.coalesce("b", F.lit(9.0))).withColumns({"__lower": F.col("y"), "__upper": F.when(F.col("a") < 4, F.col("y"))}).cache()
    read, wanted = spark.sparkContext.accumulator(0), ["squared", "aft", "absolute", "tweedie", "poisson"]

    @F.udf("double")
    def told(a):
        read.add(1)
        return a

    settings = dict(depth=3, rounds=6, rate=0.4)
    seen = rows.withColumn("a", told.asNondeterministic()("a"))
    together = models.fit_models(seen, wanted, ["a", "b"], **settings)
    assert rows.count() * 4 == read.value  # for values and for waits: one to find where to begin, one to pack the rows
    assert [f.objective for f in together] == wanted
    for one in together:
        apart = models.fit_model(rows, one.objective, ["a", "b"], **settings).model
        assert one.model.base == pytest.approx(apart.base, rel=1e-9) and len(one.model.trees) == len(apart.trees) == 6
        for x, y in zip(sum(one.model.trees, []), sum(apart.trees, [])):
            assert (x.column == y.column).all() and (x.bin == y.bin).all() and (x.missing_left == y.missing_left).all()
            assert x.value == pytest.approx(y.value, rel=1e-7, abs=1e-12)
    with pytest.raises(models.FitError):
        models.fit_models(rows, ["squared", "guess"], ["a", "b"])

    said = models.predict_each(together, rows.withColumn("objective", F.lit("old")))
    assert said.columns == ["a", "b", "y", "__lower", "__upper", "objective", "prediction"]
    for one in together:
        key = ["a", "b", "prediction"]
        assert sorted(map(str, said.where(F.col("objective") == one.objective).select(key).collect())) == sorted(map(str, models.predict(one, rows).select(key).collect()))
    with pytest.raises(ValueError):
        models.predict_each([], rows)
    rows.unpersist()


def test_rows_alike_are_scored_once_in_a_batch(monkeypatch):
    """The trees are asked about the rows of a batch that differ in their bins."""
    import numpy as np

    from tallyforge.operators import boosting

    tree = boosting.Tree(np.array([1, -1, 0, -1, -1, -1, -1]), np.array([2, 0, 1, 0, 0, 0, 0]), np.zeros(7, bool), np.arange(7.0))
    model = boosting.Boosted("squared", [np.arange(5.0), np.arange(5.0)], [10.0], [[tree], [tree]])
    x = np.random.default_rng(4).integers(0, 6, (10_000, 2)).astype(float)
    x[::9, 0] = np.nan
    want = 10 + 2 * tree.says(boosting.binned(x, model.edges))
    says, asked = boosting.Tree.says, []
    monkeypatch.setattr(boosting.Tree, "says", lambda own, bins: asked.append(len(bins)) or says(own, bins))
    assert (model.scores(x)[:, 0] == want).all() and asked == [42, 42]
    assert model.scores(x[:0]).shape == (0, 1)


def test_all_objectives_say_their_values_in_one_pass(spark):
    from tallyforge.queries import fitting

    plan = fitting.boost_values(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("ArrowEvalPython") == 1
