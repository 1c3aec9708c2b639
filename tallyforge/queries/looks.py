"""What is looked at after a run, over a fixed naive forecast so that no model is needed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import evaluate, views
from tallyforge.plans import prepare
from tallyforge.queries.common import CASES_SQL, PANEL_SQL, SERIES, c, cases, orders, rounded

DIMS = ["o_orderpriority"]


def run_tables(spark, sf_dir):
    """Panel, validation, test and forecast of a naive model: last month's value, for longer horizons that of four months ago."""
    rows = orders(spark, sf_dir)
    grid, ahead = prepare.panel(rows, SERIES), prepare.scaffold(rows, SERIES)
    order = Window.partitionBy("__series").orderBy("__step")
    past = grid.select(c("__series").alias("series"), c("__step").alias("step"), c("o_totalprice").alias("actual"), F.lag("o_totalprice", 1).over(order).alias("p1"), F.lag("o_totalprice", 4).over(order).alias("p4"))
    both = past.select("series", "step", "actual", F.inline(F.array(F.struct(F.lit("1-1").alias("bucket"), c("p1").alias("prediction")), F.struct(F.lit("2-4").alias("bucket"), c("p4").alias("prediction"))))).where("prediction IS NOT NULL")
    validation, test = both.where("step >= '1998-01-01' AND step < '1999-06-01'"), both.where("step >= '1999-06-01'")
    last = grid.groupBy(c("__series").alias("series")).agg(F.max_by("o_totalprice", "__step").alias("prediction"))
    first = grid.agg(F.max("__step").alias("last"))
    months = F.months_between("__step", "last").cast("int")
    forecast = ahead.join(F.broadcast(first)).select(c("__series").alias("series"), c("__step").alias("step"), F.when(months == 1, "1-1").when(months <= 4, "2-4").otherwise("5-6").alias("bucket")).join(last, "series")
    return grid, validation, test, forecast


def view_series_breakdown(spark, sf_dir):
    grid, validation, test, forecast = run_tables(spark, sf_dir)
    return rounded(views.aligned(views.series_view(grid, validation.unionByName(test), forecast, DIMS, "o_totalprice", DIMS)), 0)


def view_series_total(spark, sf_dir):
    grid, validation, test, forecast = run_tables(spark, sf_dir)
    return rounded(views.series_view(grid, validation.unionByName(test), forecast, DIMS, "o_totalprice", []), 0)


def view_band_by_bucket(spark, sf_dir):
    grid, validation, _, forecast = run_tables(spark, sf_dir)
    keys = views.keymap(grid, DIMS)
    future = views.future_forecast(forecast, keys, [])
    return rounded(views.series_band(validation, future, keys, []), 0)


def view_markers(spark, sf_dir):
    _, validation, test, forecast = run_tables(spark, sf_dir)
    return views.markers(validation, test, forecast)


def view_filtered(spark, sf_dir):
    """Actuals of two priorities by status, at most three lines."""
    rows = views.filter_dims(orders(spark, sf_dir), {"o_orderpriority": ["1-URGENT", "5-LOW"], "nothing": ["x"]}, ["o_orderpriority"])
    lines = views.capped_lines(rows, views.breakdown_of(["o_orderstatus", "unknown", "o_orderpriority"], ["o_orderstatus", "o_orderpriority"]), 3)
    return lines.groupBy(views.label_of(["o_orderstatus", "o_orderpriority"]).alias("label")).agg(F.count("*").alias("n"))


def _forecast_rows(spark, sf_dir):
    """Open cases with a predicted date, and the cases' dimensions."""
    rows = cases(spark, sf_dir)
    days = F.pmod("o_orderkey", F.lit(180)) + 3
    ahead = rows.where("weeks IS NULL").select(c("o_orderkey").alias("row"), F.to_date("o_orderdate").alias("anchor"), F.date_add(F.to_date("o_orderdate"), days.cast("int")).alias("predicted_date"), (days / 7.0).alias("prediction"))
    return ahead, rows.select(c("o_orderkey").alias("row"), "o_orderpriority")


def view_row_load_weekly(spark, sf_dir):
    ahead, keys = _forecast_rows(spark, sf_dir)
    return views.weekly_load(ahead, keys, DIMS)


def view_row_actuals_weekly(spark, sf_dir):
    rows = cases(spark, sf_dir).withColumn("anchor", F.to_date("o_orderdate"))
    return views.weekly_actuals(rows, "anchor", c("weeks"), 7.0, DIMS)


def view_group_dates(spark, sf_dir):
    ahead, keys = _forecast_rows(spark, sf_dir)
    return views.group_dates(ahead, keys, "o_orderpriority")


def view_series_table(spark, sf_dir):
    _, validation, test, forecast = run_tables(spark, sf_dir)
    return rounded(views.shown(views.series_table(validation, test, forecast).drop("lower", "upper")), 1)


def view_table_page(spark, sf_dir):
    """The third page of twenty open cases by predicted date."""
    ahead, keys = _forecast_rows(spark, sf_dir)
    return rounded(views.page(ahead.join(keys, "row"), ["predicted_date", "row"], 2, 20), 4)


def view_row_table(spark, sf_dir):
    """The second page of fifty open cases, the latest first, with a band of a fifth around the prediction as dates."""
    ahead, keys = _forecast_rows(spark, sf_dir)
    banded = ahead.withColumns({"lower": c("prediction") * 0.8, "upper": c("prediction") * 1.2})
    return rounded(views.page(views.row_table(banded, keys, DIMS, 7.0), [F.desc("predicted_date"), "row"], 1, 50), 4)


def view_export(spark, sf_dir):
    ahead, _ = _forecast_rows(spark, sf_dir)
    return rounded(views.export(views.shown(ahead), False), 4)


def mc_band(spark, sf_dir):
    """Weekly load with a simulated band; residuals are those of waits that ended, against the median of their priority."""
    ahead, _ = _forecast_rows(spark, sf_dir)
    seen = cases(spark, sf_dir).where("weeks > 0")
    middle = evaluate.group_median(seen, seen, "o_orderpriority", "weeks", out="prediction")
    return views.load_band(ahead, middle.select(((c("weeks") - c("prediction")) / c("prediction")).alias("resid")), 7.0)


def mc_band_even(spark, sf_dir):
    """Weekly load where all residuals are 0.24: all draws agree, so the band is one line."""
    ahead, _ = _forecast_rows(spark, sf_dir)
    return views.load_band(ahead, cases(spark, sf_dir).select(F.lit(0.24).alias("resid")), 7.0)


def mc_band_checked(spark, sf_dir):
    """Weeks with an expected load of ten or more, with whether the band holds that load and is as wide as chance makes it."""
    ahead, _ = _forecast_rows(spark, sf_dir)
    two = cases(spark, sf_dir).select(F.when(c("o_orderkey") % 2 == 0, 0.0).otherwise(1.0).alias("resid"))
    band = views.load_band(ahead, two, 7.0)
    days = c("prediction") * 7
    ends = ahead.select(F.explode(F.array(F.date_add("anchor", F.bround(days).cast("int")), F.date_add("anchor", F.bround(2 * days).cast("int")))).alias("day"))
    load = ends.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg((F.count("*") / 2).alias("mean")).where("mean >= 10")
    spread = F.sqrt(c("mean") / 2)
    held = (c("lower") <= c("mean") + 0.3 * spread + 1) & (c("upper") >= c("mean") - 0.3 * spread - 1)
    wide = (c("upper") - c("lower")).between(1.4 * spread - 1, 4.2 * spread + 1)
    return load.join(band, "week", "left").select("week", F.coalesce(held & wide, F.lit(False)).alias("sound"))


def leaderboard(spark, sf_dir):
    """Customers as recipes: the best 25 by mean price, then by how many orders they have."""
    rows = orders(spark, sf_dir).groupBy(c("o_custkey").alias("recipe")).agg(F.round(F.avg("o_totalprice"), 2).alias("fitness"), F.count("*").alias("size"))
    return views.leaderboard(rows)


QUERIES = {
    "view_series_breakdown": view_series_breakdown, "view_series_total": view_series_total, "view_band_by_bucket": view_band_by_bucket, "view_markers": view_markers, "view_filtered": view_filtered,
    "view_row_load_weekly": view_row_load_weekly, "view_row_actuals_weekly": view_row_actuals_weekly, "view_group_dates": view_group_dates, "view_series_table": view_series_table,
    "view_table_page": view_table_page, "view_row_table": view_row_table, "view_export": view_export, "mc_band": mc_band, "mc_band_even": mc_band_even, "mc_band_checked": mc_band_checked, "leaderboard": leaderboard,
}

_RUN = f"""WITH {PANEL_SQL}, lags AS (SELECT series, step, y, lag(y, 1) OVER (PARTITION BY series ORDER BY step) AS p1, lag(y, 4) OVER (PARTITION BY series ORDER BY step) AS p4 FROM panel),
pr AS (SELECT series, step, '1-1' AS bucket, y AS actual, p1 AS prediction FROM lags WHERE p1 IS NOT NULL UNION ALL SELECT series, step, '2-4', y, p4 FROM lags WHERE p4 IS NOT NULL),
val AS (SELECT * FROM pr WHERE step >= DATE '1998-01-01' AND step < DATE '1999-06-01'), tst AS (SELECT * FROM pr WHERE step >= DATE '1999-06-01'),
fc AS (SELECT series, ((SELECT max(step) FROM panel) + to_months(k::INTEGER))::DATE AS step, CASE WHEN k = 1 THEN '1-1' WHEN k <= 4 THEN '2-4' ELSE '5-6' END AS bucket, arg_max(y, panel.step) AS prediction FROM panel, range(1, 7) r(k) GROUP BY series, k),
past AS (SELECT series, step, avg(prediction) AS p FROM (SELECT * FROM val UNION ALL SELECT * FROM tst) GROUP BY 1, 2)"""
_AHEAD = f"""WITH {CASES_SQL}, ahead AS (SELECT o_orderkey AS row, anchor, anchor + (o_orderkey % 180 + 3)::INTEGER AS predicted_date, (o_orderkey % 180 + 3) / 7.0::DOUBLE AS prediction, o_orderpriority FROM cases WHERE weeks IS NULL)"""

ORACLES = {
    "view_series_breakdown": f"""{_RUN}, l AS (SELECT series, step, p FROM past UNION ALL SELECT series, step, prediction FROM fc), ax AS (SELECT step FROM panel UNION SELECT step FROM l)
SELECT s.series AS label, ax.step, round(p.y, 0) AS actual, round(l.p, 0) AS forecast FROM (SELECT DISTINCT series FROM panel) s CROSS JOIN ax LEFT JOIN panel p ON p.series = s.series AND p.step = ax.step LEFT JOIN l ON l.series = s.series AND l.step = ax.step""",
    "view_series_total": f"""{_RUN}, l AS (SELECT step, sum(p) AS p FROM past GROUP BY 1 UNION ALL SELECT step, sum(prediction) FROM fc GROUP BY 1), a AS (SELECT step, sum(y) AS y FROM panel GROUP BY 1)
SELECT 'all' AS label, step, round(y, 0) AS actual, round(p, 0) AS forecast FROM a FULL JOIN l USING (step)""",
    "view_band_by_bucket": f"""{_RUN}, v AS (SELECT bucket, step, sum(actual) AS actual, sum(prediction) AS prediction FROM val GROUP BY ALL),
h AS (SELECT bucket, min(actual) >= 0 AND median(actual) > 0 AS rel, greatest(0.1 * median(abs(actual)), 1e-6) AS fl FROM v GROUP BY 1),
b AS (SELECT bucket, rel, fl, count(*) AS n, quantile_cont(abs((actual - prediction) / greatest(abs(prediction), fl)), 0.8) AS w FROM v JOIN h USING (bucket) GROUP BY ALL),
f AS (SELECT step, bucket, sum(prediction) AS prediction FROM fc GROUP BY ALL)
SELECT step, bucket, round(prediction, 0) AS prediction, round(prediction - w * greatest(abs(prediction), fl), 0) AS lower, round(prediction + w * greatest(abs(prediction), fl), 0) AS upper FROM f LEFT JOIN b USING (bucket)""",
    "view_markers": f"{_RUN} SELECT 'validation start' AS label, min(step) AS step FROM val UNION ALL SELECT 'test start', min(step) FROM tst UNION ALL SELECT 'forecast origin', min(step) FROM fc",
    "view_filtered": """WITH f AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')), l AS (SELECT DISTINCT o_orderstatus, o_orderpriority FROM f ORDER BY 1, 2 LIMIT 3)
SELECT o_orderstatus || '|' || o_orderpriority AS label, count(*) AS n FROM f JOIN l USING (o_orderstatus, o_orderpriority) GROUP BY 1""",
    "view_row_load_weekly": f"{_AHEAD} SELECT o_orderpriority, date_trunc('week', predicted_date)::DATE AS week, count(*) AS n FROM ahead GROUP BY ALL",
    "view_row_actuals_weekly": f"WITH {CASES_SQL} SELECT o_orderpriority, date_trunc('week', anchor + round_even(weeks * 7, 0)::INTEGER)::DATE AS week, count(*) AS n FROM cases WHERE weeks IS NOT NULL GROUP BY ALL",
    "view_group_dates": f"{_AHEAD} SELECT o_orderpriority, count(*) AS n, min(predicted_date) AS earliest, max(predicted_date) AS latest FROM ahead GROUP BY 1",
    "view_series_table": f"""{_RUN} SELECT series, strftime(step, '%Y-%m-%d') AS step, bucket, round(actual, 1) AS actual, round(prediction, 1) AS prediction, FALSE AS future FROM (SELECT * FROM val UNION ALL SELECT * FROM tst)
UNION ALL SELECT series, strftime(step, '%Y-%m-%d'), bucket, NULL, round(prediction, 1), TRUE FROM fc""",
    "view_table_page": f"{_AHEAD} SELECT row, anchor, predicted_date, round(prediction, 4) AS prediction, o_orderpriority FROM ahead ORDER BY predicted_date, row LIMIT 20 OFFSET 40",
    "view_row_table": f"""{_AHEAD} SELECT row, o_orderpriority, anchor, predicted_date, round(prediction, 4) AS prediction, anchor + round(prediction * 0.8::DOUBLE * 7, 0)::INTEGER AS lower, anchor + round(prediction * 1.2::DOUBLE * 7, 0)::INTEGER AS upper
FROM ahead ORDER BY predicted_date DESC, row LIMIT 50 OFFSET 50""",
    "mc_band_even": f"""{_AHEAD}, w AS (SELECT date_trunc('week', anchor + round_even(prediction * 1.24::DOUBLE * 7, 0)::INTEGER)::DATE AS week, count(*)::DOUBLE AS n FROM ahead GROUP BY 1)
SELECT week, n AS lower, n AS upper FROM w""",
    "mc_band_checked": f"""{_AHEAD}, e AS (SELECT anchor + (prediction * 7)::INTEGER AS day FROM ahead UNION ALL SELECT anchor + (prediction * 14)::INTEGER FROM ahead)
SELECT date_trunc('week', day)::DATE AS week, TRUE AS sound FROM e GROUP BY 1 HAVING count(*) >= 20""",
    "view_export": f"{_AHEAD} SELECT row, strftime(anchor, '%Y-%m-%d') AS anchor, strftime(predicted_date, '%Y-%m-%d') AS predicted_date, round(prediction, 4) AS prediction, 'not trusted' AS verdict FROM ahead",
    "leaderboard": "SELECT o_custkey AS recipe, round(avg(o_totalprice), 2) AS fitness, count(*) AS size FROM orders GROUP BY 1 ORDER BY 2, 3, 1 LIMIT 25",
}
