"""Models, searches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import boosting, forecast, models
from tallyforge.queries.common import CASES, CASES_SQL, SERIES, c, cases, orders, rounded, table
from tallyforge.sources.shared import new_path, table_folder, written
from tallyforge.spec import LOWER, UPPER, Column, PrepSpec
from tallyforge.streaming import judgements

FAMILIES = ("dim:o_orderpriority", "lag+0", "lag+1", "roll:4", "roll:13", "cal:month", "season")


_FITTED: dict = {}


def _once(spark, sf_dir, name, build):
    """What ``build`` gives, worked out once for each application, folder and run: a fit serves its query and the check of it."""
    key = (spark.sparkContext.applicationId, sf_dir, name, table_folder(spark))
    if key not in _FITTED:
        _FITTED[key] = written(build())
    return _FITTED[key]


def fit_series(spark, sf_dir):
    """A frozen recipe over the monthly panel: the forecast of all buckets with bands."""

    def build():
        ws = forecast.series_workspace(orders(spark, sf_dir), SERIES, "month")
        try:
            return written(rounded(forecast.finish(ws, forecast.Recipe(FAMILIES, "squared", 3, 20, 0.2))["forecast"], 2))
        finally:
            ws.release()

    return _once(spark, sf_dir, "fit_series", build)


def fit_rows(spark, sf_dir):
    """Waiting times by boosted trees that know open cases: open cases with a predicted date and a band."""

    def build():
        ws = forecast.row_workspace(cases(spark, sf_dir), CASES)
        try:
            out = forecast.finish(ws, forecast.Recipe(("dim:o_orderpriority", "log:o_totalprice", "date:month"), "aft", 3, 20, 0.2))
            return written(rounded(out["forecast"].drop("bucket"), 2))
        finally:
            ws.release()

    return _once(spark, sf_dir, "fit_rows", build)


def fit_classes(spark, sf_dir):
    """Order status from price and date: class and probability of orders after the training cut."""

    def build():
        spec = PrepSpec("row", (Column("o_orderdate", "anchor"), Column("o_orderpriority", "dimension"), Column("o_totalprice", "measure"), Column("o_orderstatus", "target")), task="classification")
        ws = forecast.row_workspace(orders(spark, sf_dir).withColumn("__row", c("o_orderkey")), spec)
        try:
            found = forecast.phase(ws, forecast.Recipe(("measure:o_totalprice", "date:month", "date:trend"), "softprob", 3, 10, 0.3), ("train",), "val")
            return written(rounded(found.select(c("__row").alias("row"), "actual", "class", "probability"), 4))
        finally:
            ws.release()

    return _once(spark, sf_dir, "fit_classes", build)


def fit_maps(spark, sf_dir):
    """A classifier over maps of features: event kinds from value and user."""

    def build():
        rows = table(spark, sf_dir, "events").withColumns({"label": F.when(c("value") >= 5, "high").otherwise("low"), "features": F.create_map(F.lit("value"), c("value"), F.when(c("user_id") % 2 == 0, "even").otherwise("odd"), F.lit(1.0))})
        fitted = models.fit_maps(rows, depth=3, rounds=10, rate=0.5)
        return rounded(models.predict_maps(fitted, rows).groupBy("label", "class").agg(F.count("*").alias("n"), F.avg("probability").alias("probability")), 4)

    return _once(spark, sf_dir, "fit_maps", build)


def fit_maps_names(spark, sf_dir):
    """A classifier over maps whose features are named as columns and targets are elsewhere."""
    kind = c("user_id") % 7
    rows = table(spark, sf_dir, "events").withColumns({"label": F.when(kind >= 3, "high").otherwise("low"), "features": F.create_map(F.lit("a.b"), kind.cast("double"), F.lit("y"), c("value"), F.lit("label"), F.lit(1.0))})
    fitted = models.fit_maps(rows, depth=2, rounds=5, rate=0.5)
    return models.predict_maps(fitted, rows).groupBy("label", "class").agg(F.count("*").alias("n"))


PRIORITY, MONTH = "CAST(substr(o_orderpriority, 1, 1) AS INT)", "month(o_orderdate)"
_KNOWN = f"CASE WHEN {PRIORITY} <= 2 AND {MONTH} <= 6 THEN 3 WHEN {PRIORITY} <= 2 THEN 5 WHEN {MONTH} <= 6 THEN 8 ELSE 12 END"


def _ruled(spark, sf_dir):
    """Orders with two inputs, a value that they decide, and what class it is of."""
    rows = orders(spark, sf_dir).selectExpr("o_orderkey", f"{PRIORITY} AS priority", f"{MONTH} AS month", f"CAST({_KNOWN} AS DOUBLE) AS y")
    return rows.withColumns({LOWER: c("y"), UPPER: c("y"), "two": F.when(c("y") > 6, "long").otherwise("short"), "four": F.concat(F.lit("v"), c("y").cast("int"))})


def boost_values(spark, sf_dir):
    """Boosted trees of each objective for values on rows whose value is a rule: what they say of each order."""
    rows = _ruled(spark, sf_dir)
    fitted = models.fit_models(rows, ["squared", "absolute", "tweedie", "poisson", "aft"], ["priority", "month"], depth=2, rounds=16, rate=0.6)
    return models.predict_each(fitted, rows).select("o_orderkey", "objective", F.round("prediction", 1).alias("prediction"))


def boost_classes(spark, sf_dir):
    """Boosted trees for two and four classes on rows whose class is a rule: the class that each order gets."""
    rows, out = _ruled(spark, sf_dir), None
    for objective, y in (("logistic", "two"), ("softprob", "four")):
        fitted = models.fit_model(rows, objective, ["priority", "month"], y=y, depth=2, rounds=6, rate=0.6)
        part = models.predict(fitted, rows).select("o_orderkey", F.lit(objective).alias("objective"), "class", (c("probability") > 0.6).alias("sure"))
        out = part if out is None else out.unionByName(part)
    return out


def boost_waits(spark, sf_dir):
    """Every fourth order's wait is still open at a third of its length; trees that know so expect all waits as they are."""
    rows = _ruled(spark, sf_dir).withColumn("open", c("o_orderkey") % 4 == 0)
    rows = rows.withColumns({LOWER: F.when(c("open"), c("y") / 3).otherwise(c("y")), UPPER: F.when(~c("open"), c("y"))})
    aware = models.fit_model(rows, "aft", ["priority", "month"], depth=2, rounds=24, rate=0.6)
    blind = models.fit_model(rows.where("open OR month > 0").withColumn("y", c(LOWER)), "absolute", ["priority", "month"], depth=2, rounds=8, rate=0.6)
    said = models.predict(aware, rows).withColumnRenamed("prediction", "aware")
    said = models.predict(blind, said)
    return said.select("o_orderkey", "open", (F.abs(c("aware") / c("y") - 1) < 0.45).alias("near"), (c("aware") >= c(LOWER)).alias("waits"), (c("aware") >= c("prediction") * 0.99).alias("longer"))


def boost_histogram(spark, sf_dir):
    """The sums from which the second round's first split is read, after a first round that splits by priority."""
    rows = _ruled(spark, sf_dir).withColumn("y", F.when(c("priority") <= 2, 10.0).otherwise(20.0))
    fitted = models.fit_model(rows, "squared", ["priority", "month"], depth=1, rounds=1, rate=0.5)
    return rounded(boosting.histogram(rows, ["priority", "month"], fitted.model, c("y")), 1)


def search_recipes(spark, sf_dir):
    """A search over recipes with the defaults, over all horizons: the leaderboard."""
    ws = forecast.series_workspace(orders(spark, sf_dir), SERIES, "month")
    try:
        board = forecast.search(ws, seed=3)
    finally:
        ws.release()
    rows = [(e.recipe.key(), e.recipe.objective, list(e.recipe.families), float(e.fitness)) for e in board.entries]
    return spark.createDataFrame(rows, "recipe string, objective string, families array<string>, fitness double")


def fit_series_checked(spark, sf_dir):
    """Each step ahead of each series, with whether its forecast is not below zero and its band in order."""
    return fit_series(spark, sf_dir).select("series", "step", _sound((c("prediction") >= 0) & (c("lower") <= c("upper"))))


def fit_rows_checked(spark, sf_dir):
    """Each open case, with whether it is expected to wait, and to end no sooner than it began."""
    return fit_rows(spark, sf_dir).select("row", "anchor", _sound((c("prediction") >= 0) & (c("predicted_date") >= c("anchor")) & (c("lower") <= c("upper"))))


def fit_classes_checked(spark, sf_dir):
    """Each order of the validation span, with whether it got a class that there is, at a chance that there can be."""
    return fit_classes(spark, sf_dir).select("row", "actual", _sound(c("class").isin("F", "O", "P") & c("probability").between(0, 1)))


def fit_maps_checked(spark, sf_dir):
    """How many events were classified, and whether more than 95 % of them rightly: the label is a rule on one feature."""
    rows = fit_maps(spark, sf_dir)
    return rows.agg(F.sum("n").alias("n"), _sound(F.sum(F.when(c("label") == c("class"), c("n"))) > 0.95 * F.sum("n")))


def _sound(test):
    return F.coalesce(test, F.lit(False)).alias("sound")


def stream_judgements(spark, sf_dir):
    """Orders as a stream of judgements, folded to each customer's latest state."""
    schema = orders(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/orders.parquet*")
    action = F.when(c("o_orderkey") % 5 == 0, "exclude").otherwise("label")
    latest = judgements.latest_judgements(stream.select(F.concat(F.lit("t"), "o_custkey").alias("tile"), c("o_orderkey").alias("at"), action.alias("action"), c("o_orderpriority").alias("label")))
    return _drained(spark, latest, "complete")


def stream_upserts(spark, sf_dir):
    """Orders as a stream of judgements in several epochs, folded into a table by buckets: the records that are left."""
    source, path = new_path(spark, "events"), new_path(spark, "judged")
    action = F.when(c("o_orderkey") % 7 == 0, "clear").when(c("o_orderkey") % 5 == 0, "exclude").otherwise("label")
    events = orders(spark, sf_dir).select(F.concat(F.lit("t"), "o_custkey").alias("tile"), c("o_orderkey").alias("at"), action.alias("action"), c("o_orderpriority").alias("label"))
    events.repartition(4, F.xxhash64("at")).write.parquet(source)
    kept = judgements.JudgementTable(spark, path, 8)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).foreachBatch(kept.fold).start()
    query.awaitTermination()
    return kept.records()


def stream_rollup(spark, sf_dir):
    """Orders rolled up by thirty days as a stream, with a watermark: closed steps only."""
    schema = orders(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/orders.parquet*").withColumn("o_orderdate", c("o_orderdate").cast("timestamp"))
    return rounded(_drained(spark, judgements.step_rollup(stream, "o_orderdate", "o_totalprice", ["o_orderpriority"], "30 days"), "append"), 2)


def _drained(spark, stream, mode):
    """What a stream gives once it has read all there is, from a table in the shared folder."""
    path = new_path(spark, "stream")

    def write(batch, epoch):  # a batch that comes again after a failure replaces itself
        batch.write.mode("overwrite").parquet(path + ("/out" if mode == "complete" else f"/out/epoch={epoch}"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", path + "/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + ("/out" if mode == "complete" else "/out/epoch=*"))


NAMES = ("fit_series", "fit_rows", "fit_classes", "fit_maps", "fit_maps_names", "boost_values", "boost_classes", "boost_waits", "boost_histogram", "fit_series_checked", "fit_rows_checked", "fit_classes_checked", "fit_maps_checked", "search_recipes", "stream_judgements", "stream_upserts", "stream_rollup")
QUERIES = {name: globals()[name] for name in NAMES}
_RULE = f"WITH r AS (SELECT o_orderkey, {PRIORITY} AS priority, {MONTH} AS month, {_KNOWN} AS v FROM orders)"
ORACLES = {
    "fit_maps_names": "SELECT CASE WHEN user_id % 7 >= 3 THEN 'high' ELSE 'low' END AS label, CASE WHEN user_id % 7 >= 3 THEN 'high' ELSE 'low' END AS class, count(*) AS n FROM events GROUP BY ALL",
    "boost_values": f"{_RULE} SELECT o_orderkey, objective, v::DOUBLE AS prediction FROM r, (SELECT unnest(['squared', 'absolute', 'tweedie', 'poisson', 'aft']) AS objective)",
    "boost_classes": f"""{_RULE} SELECT o_orderkey, 'logistic' AS objective, CASE WHEN v > 6 THEN 'long' ELSE 'short' END AS class, TRUE AS sure FROM r
UNION ALL SELECT o_orderkey, 'softprob', 'v' || v, TRUE FROM r""",
    "boost_waits": "SELECT o_orderkey, o_orderkey % 4 = 0 AS open, TRUE AS near, TRUE AS waits, TRUE AS longer FROM orders",
    "boost_histogram": f"""{_RULE}, y AS (SELECT priority, month, priority <= 2 AS low, CASE WHEN priority <= 2 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS y FROM r), b AS (SELECT avg(y) AS base FROM y),
leaf AS (SELECT low, -0.5::DOUBLE * sum(base - y) / (count(*) + 1) AS v FROM y, b GROUP BY low), g AS (SELECT y.*, base + v - y AS g FROM y JOIN leaf USING (low), b),
f AS (SELECT 'priority' AS feature, priority - 1 AS bin, g FROM g UNION ALL SELECT 'month', month - 1, g FROM g)
SELECT feature, bin::BIGINT AS bin, round(sum(g), 1) AS g, count(*)::DOUBLE AS h, count(*) AS n FROM f GROUP BY ALL""",
    "fit_series_checked": """WITH m AS (SELECT max(date_trunc('month', o_orderdate)) AS last FROM orders)
SELECT o_orderpriority AS series, (last + to_months(k::INTEGER))::DATE AS step, TRUE AS sound FROM m, range(1, 7) r(k), (SELECT DISTINCT o_orderpriority FROM orders)""",
    "fit_rows_checked": f"WITH {CASES_SQL} SELECT o_orderkey AS row, anchor, TRUE AS sound FROM cases WHERE weeks IS NULL",
    "fit_classes_checked": """WITH e AS (SELECT max(o_orderdate)::DATE AS last FROM orders)
SELECT o_orderkey AS row, o_orderstatus AS actual, TRUE AS sound FROM orders, e WHERE o_orderdate::DATE >= last - 364 AND o_orderdate::DATE < last - 273""",
    "fit_maps_checked": "SELECT count(*) AS n, TRUE AS sound FROM events",
    "stream_rollup": """WITH d AS (SELECT DATE '1970-01-01' + (30 * (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) // 30))::INTEGER AS step, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, count(*) AS n FROM orders GROUP BY ALL)
SELECT * FROM d WHERE step + 30 <= (SELECT max(o_orderdate)::DATE FROM orders) - 7""",
    "stream_upserts": """WITH x AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT 't' || o_custkey AS tile, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS label, o_orderkey % 5 = 0 AS excluded FROM x WHERE o_orderkey % 7 <> 0""",
    "stream_judgements": """WITH x AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT 't' || o_custkey AS tile, CASE WHEN o_orderkey % 5 = 0 THEN 'exclude' ELSE 'label' END AS action, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS label FROM x""",
}
