"""Errors, bands, baselines and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import evaluate
from tallyforge.queries.common import c, cases, orders, rounded


def judged(spark, sf_dir):
    """A prediction for every order with an earlier one of its customer: that one's price; the bucket is by quarter."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = orders(spark, sf_dir).withColumn("prediction", F.lag("o_totalprice").over(order))
    return rows.select("o_orderkey", "o_custkey", "o_orderpriority", F.concat(F.lit("q"), F.quarter("o_orderdate")).alias("bucket"), c("o_totalprice").alias("actual"), "prediction", F.date_trunc("week", "o_orderdate").cast("date").alias("period")).where("prediction IS NOT NULL")


JUDGED = """j AS (SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderpriority, 'q' || quarter(o_orderdate) AS bucket, o_totalprice AS actual,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prediction, date_trunc('week', o_orderdate)::DATE AS period FROM orders) WHERE prediction IS NOT NULL)"""


def metric_wape_mae(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rounded(rows.groupBy("bucket").agg(evaluate.wape(c("actual"), c("prediction")).alias("wape"), evaluate.mae(c("actual"), c("prediction")).alias("mae")), 6, mae=2)


def _probabilities():
    parts = [F.pmod(c("o_orderkey") * 7 + i * 3, F.lit(11)) + 1 for i in range(3)]
    total = reduce(lambda a, b: a + b, parts)
    return F.array(*[p / total for p in parts])


def metric_log_loss_brier(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumns({"code": F.pmod("o_custkey", F.lit(3)), "p": _probabilities()})
    return rounded(rows.groupBy("o_orderpriority").agg(evaluate.log_loss(c("code"), c("p")).alias("log_loss"), evaluate.brier(c("code"), c("p")).alias("brier")))


def open_consistency(spark, sf_dir):
    from tallyforge.plans.prepare import prepare_rows
    from tallyforge.queries.common import CASES

    _, ahead = prepare_rows(cases(spark, sf_dir), CASES)
    return rounded(ahead.groupBy("o_orderpriority").agg(evaluate.open_consistency(c("o_totalprice") / 5000, c("__lower")).alias("share"), F.count("*").alias("n")))


def band_fit(spark, sf_dir):
    """Bands per bucket, relative by the data's own sign, and one absolute band."""
    rows = evaluate.stored(judged(spark, sf_dir))
    both = evaluate.fit_band(rows, ["bucket"]).unionByName(evaluate.fit_band(rows.withColumn("bucket", F.lit("all")), ["bucket"], relative=False))
    return rounded(both, 5, lo=4, hi=4, floor=2)


def band_few(spark, sf_dir):
    """Symmetric bands from few residuals, none under four: one for each customer and bucket."""
    return rounded(evaluate.fit_band(evaluate.stored(judged(spark, sf_dir)), ["bucket", "o_custkey"]), 4)


def band_apply(spark, sf_dir):
    rows = evaluate.stored(judged(spark, sf_dir).select("o_orderkey", "bucket", "actual", "prediction"))
    banded = evaluate.apply_band(rows, evaluate.fit_band(rows, ["bucket"]), ["bucket"], nonnegative=True)
    return rounded(banded.select("o_orderkey", "lower", "upper"), 1)


def _banded(spark, sf_dir):
    rows = evaluate.stored(judged(spark, sf_dir))
    return evaluate.apply_band(rows, evaluate.fit_band(rows, ["bucket"]), ["bucket"])


def band_coverage(spark, sf_dir):
    facts = evaluate.band_facts(_banded(spark, sf_dir), ["bucket"], evaluate.coverage(c("actual"), c("lower"), c("upper")).alias("coverage"))
    return rounded(facts.select("bucket", "coverage", "width", "spread"), 4, width=1, spread=1)


def _split(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("y", c("o_totalprice"))
    return rows.where("o_orderdate < '1997-01-01'"), rows.where("o_orderdate >= '1997-01-01'")


def baseline_group_median(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return rounded(evaluate.group_median(train, test, "o_custkey", "y").select("o_orderkey", "baseline"), 3)


def baseline_best_dimension(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return rounded(evaluate.best_dimension(train, test, ["o_custkey", "o_orderpriority", "o_orderstatus"], "y"), 6)


def class_prior(spark, sf_dir):
    return rounded(evaluate.class_prior(orders(spark, sf_dir), "o_orderpriority"), 8)


def fitness_by_period(spark, sf_dir):
    return rounded(evaluate.contributions(judged(spark, sf_dir), c("period")), 9)


def gain_significance(spark, sf_dir):
    """Whether predicting from the last order's price beats a flat price, week by week."""
    rows = judged(spark, sf_dir)
    flat = evaluate.contributions(rows.withColumn("prediction", F.lit(200000.0)), c("period"))
    return rounded(evaluate.significant_gain(flat, evaluate.contributions(rows, c("period"))), 6)


def verdict_checks(spark, sf_dir):
    """The verdict on each bucket's rows against the flat baseline, one row per check."""
    extra = evaluate.wape(c("actual"), c("prediction")).alias("e"), evaluate.wape(c("actual"), F.lit(200000.0)).alias("b"), evaluate.coverage(c("actual"), c("lower"), c("upper")).alias("c"), F.count("*").alias("n"), F.count_distinct("period").alias("s")
    facts = evaluate.band_facts(_banded(spark, sf_dir), ["bucket"], *extra)
    out = []
    for r in facts.collect():  # a few buckets
        v = evaluate.judge(r["e"], r["b"], r["c"], r["n"], r["s"], width=r["width"], own_spread=r["spread"])
        out += [(r["bucket"], x["check"], x["passed"], v["trusted"]) for x in v["checks"]]
    return spark.createDataFrame(out, "bucket string, check string, passed boolean, trusted boolean")


QUERIES = {
    "metric_wape_mae": metric_wape_mae, "metric_log_loss_brier": metric_log_loss_brier, "open_consistency": open_consistency, "band_fit": band_fit, "band_few": band_few,
    "band_apply": band_apply, "band_coverage": band_coverage, "baseline_group_median": baseline_group_median, "baseline_best_dimension": baseline_best_dimension,
    "class_prior": class_prior, "fitness_by_period": fitness_by_period, "gain_significance": gain_significance, "verdict_checks": verdict_checks,
}


def _band(by: str, rel: str = "min(actual) >= 0 AND median(actual) > 0", source: str = "j", more: str = "") -> str:
    return f"""h AS (SELECT {by}, {rel} AS relative, median(abs(actual)) AS m FROM {source} GROUP BY ALL),
hf AS (SELECT {by}, relative, CASE WHEN relative THEN greatest(0.1 * m, 1e-6) ELSE 1.0 END::DOUBLE AS floor FROM h),
re AS (SELECT {by}, relative, floor, (actual - prediction) / CASE WHEN relative THEN greatest(abs(prediction), floor) ELSE 1 END AS r FROM {source} JOIN hf USING ({by})),
bd AS (SELECT {by}, relative, floor, count(*) AS n, CASE WHEN count(*) >= 20 THEN quantile_cont(r, 0.1) WHEN count(*) >= 4 THEN -quantile_cont(abs(r), 0.8) END AS lo,
  CASE WHEN count(*) >= 20 THEN quantile_cont(r, 0.9) WHEN count(*) >= 4 THEN quantile_cont(abs(r), 0.8) END AS hi FROM re GROUP BY ALL)"""


_EDGES = "prediction + lo * CASE WHEN relative THEN greatest(abs(prediction), floor) ELSE 1 END AS lower, prediction + hi * CASE WHEN relative THEN greatest(abs(prediction), floor) ELSE 1 END AS upper"
_FACTS = f"""WITH {JUDGED}, {_band('bucket')}, e AS (SELECT *, {_EDGES} FROM j JOIN bd USING (bucket))"""

ORACLES = {
    "metric_wape_mae": f"WITH {JUDGED} SELECT bucket, round(sum(abs(actual - prediction)) / sum(abs(actual)), 6) AS wape, round(avg(abs(actual - prediction)), 2) AS mae FROM j GROUP BY 1",
    "metric_log_loss_brier": """WITH p AS (SELECT o_orderpriority, o_custkey % 3 AS code, (o_orderkey * 7) % 11 + 1 AS a, (o_orderkey * 7 + 3) % 11 + 1 AS b, (o_orderkey * 7 + 6) % 11 + 1 AS d FROM orders),
q AS (SELECT *, (a + b + d)::DOUBLE AS t, CASE code WHEN 0 THEN a WHEN 1 THEN b ELSE d END AS own FROM p)
SELECT o_orderpriority, round(avg(-ln(own / t)), 6) AS log_loss, round(avg((a / t) ** 2 + (b / t) ** 2 + (d / t) ** 2 - 2 * own / t + 1), 6) AS brier FROM q GROUP BY 1""",
    "open_consistency": """WITH l AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS open FROM orders)
SELECT o_orderpriority, round(avg((o_totalprice / 5000 >= date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) / 7.0::DOUBLE)::INTEGER), 6) AS share, count(*) AS n FROM l WHERE open GROUP BY 1""",
    "band_fit": f"""WITH {JUDGED}, {_band('bucket')}, ja AS (SELECT 'all' AS bucket, actual, prediction FROM j)
SELECT bucket, round(lo, 4) AS lo, round(hi, 4) AS hi, relative, round(floor, 2) AS floor, n FROM bd
UNION ALL SELECT bucket, round(quantile_cont(actual - prediction, 0.1), 4), round(quantile_cont(actual - prediction, 0.9), 4), FALSE, 1.0, count(*) FROM ja GROUP BY bucket""",
    "band_few": f"""WITH {JUDGED}, {_band('bucket, o_custkey')}
SELECT bucket, o_custkey, round(lo, 4) AS lo, round(hi, 4) AS hi, relative, round(floor, 4) AS floor, n FROM bd""",
    "band_apply": f"{_FACTS} SELECT o_orderkey, round(greatest(lower, 0), 1) AS lower, round(upper, 1) AS upper FROM e",
    "band_coverage": f"""{_FACTS} SELECT bucket, round(avg((actual BETWEEN lower AND upper)::INTEGER), 4) AS coverage, round(median(upper - lower), 1) AS width, round(quantile_cont(actual, 0.9) - quantile_cont(actual, 0.1), 1) AS spread FROM e GROUP BY 1""",
    "baseline_group_median": """WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
SELECT o_orderkey, round(coalesce(m, (SELECT median(o_totalprice) FROM t)), 3) AS baseline FROM orders LEFT JOIN (SELECT o_custkey, median(o_totalprice) AS m FROM t GROUP BY 1) USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '1997-01-01'""",
    "baseline_best_dimension": "WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), v AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'), o AS (SELECT median(o_totalprice) AS m FROM t) "
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(sum(abs(v.o_totalprice - coalesce(g.m, o.m))) / sum(v.o_totalprice), 6) AS error FROM v LEFT JOIN (SELECT {d}, median(o_totalprice) AS m FROM t GROUP BY 1) g USING ({d}), o" for d in ("o_custkey", "o_orderpriority", "o_orderstatus")),
    "class_prior": "SELECT o_orderpriority AS label, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 8) AS share FROM orders GROUP BY 1",
    "fitness_by_period": f"WITH {JUDGED} SELECT period, round(sum(abs(actual - prediction)) / (SELECT sum(abs(actual)) FROM j), 9) AS loss FROM j GROUP BY 1",
    "gain_significance": f"""WITH {JUDGED}, p AS (SELECT period, sum(abs(actual - prediction)) - sum(abs(actual - 200000)) AS d FROM j GROUP BY 1), q AS (SELECT d / (SELECT sum(actual) FROM j) AS d FROM p)
SELECT round(sum(d), 6) AS gain, sum(d) > stddev_samp(d) * sqrt(count(*)) AS significant FROM q""",
    "verdict_checks": f"""{_FACTS}, f AS (SELECT bucket, sum(abs(actual - prediction)) / sum(abs(actual - 200000)) <= 0.9 AS a, avg((actual BETWEEN lower AND upper)::INTEGER) BETWEEN 0.65 AND 0.95 AS b,
  median(upper - lower) < quantile_cont(actual, 0.9) - quantile_cont(actual, 0.1) AS d, count(*) >= 30 AND count(DISTINCT period) >= 13 AS g FROM e GROUP BY 1)
SELECT bucket, unnest(['beats the naive baseline', 'band is calibrated', 'band is sharper than the data''s own spread', 'enough history to judge']) AS "check", unnest([a, b, d, g]) AS passed, a AND b AND d AND g AS trusted FROM f""",
}
