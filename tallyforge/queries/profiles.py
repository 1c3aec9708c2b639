"""What training rows look like."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import profile
from tallyforge.plans import prepare
from tallyforge.queries.common import CASES, CASES_SQL, PANEL_SQL, SERIES, c, cases, orders, rounded
from tallyforge.spec import Column, PrepSpec

WEEKLY = PrepSpec("series", (Column("o_orderdate", "time"), Column("o_orderpriority", "dimension"), Column("n", "measure", "count"), Column("o_totalprice", "target", "sum")), step="week", horizon=8)


def weekly(spark, sf_dir):
    return prepare.panel(orders(spark, sf_dir).withColumn("n", c("o_orderkey")), WEEKLY)


def profile_stats(spark, sf_dir):
    return rounded(profile.number_stats(cases(spark, sf_dir), ["o_totalprice", "weeks"]), 4)


def profile_text(spark, sf_dir):
    return rounded(profile.text_stats(orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus"]), 6)


def profile_top_levels(spark, sf_dir):
    return profile.top_levels(orders(spark, sf_dir), ["o_orderpriority", "o_custkey"])


def leak_check(spark, sf_dir):
    rows = cases(spark, sf_dir).withColumns({"plus": c("weeks") + 1, "scaled": c("weeks") * 3 + F.pmod("o_orderkey", F.lit(3)), "fair": c("o_totalprice")})
    return rounded(profile.leaks(rows, ["plus", "scaled", "fair"], "weeks"), 5)


def profile_totals(spark, sf_dir):
    totals = profile.step_totals(prepare.panel(orders(spark, sf_dir), SERIES), "o_totalprice")
    return rounded(totals.select(c("__step").alias("step"), "pos", "total"), 2)


def profile_trend(spark, sf_dir):
    return rounded(profile.trend(profile.step_totals(prepare.panel(orders(spark, sf_dir), SERIES), "o_totalprice")), 6, mean_total=1, slope=2)


def profile_acf(spark, sf_dir):
    return rounded(profile.autocorrelation(profile.step_totals(weekly(spark, sf_dir), "o_totalprice")), 6)


def profile_season(spark, sf_dir):
    return rounded(profile.season(profile.autocorrelation(profile.step_totals(weekly(spark, sf_dir), "o_totalprice"))), 6)


def profile_lead_lag(spark, sf_dir):
    return rounded(profile.lead_lags(weekly(spark, sf_dir), "n", "o_totalprice"), 6)


def profile_best_lead(spark, sf_dir):
    return rounded(profile.best_lead(profile.lead_lags(weekly(spark, sf_dir), "n", "o_totalprice")), 6)


def profile_censored(spark, sf_dir):
    rows, _ = prepare.prepare_rows(cases(spark, sf_dir), CASES)
    return rounded(profile.censored_share(rows), 8)


def profile_zero_shares(spark, sf_dir):
    return rounded(profile.zero_shares(weekly(spark, sf_dir), "o_totalprice"), 6)


def profile_genes(spark, sf_dir):
    """What the search would start from, for the cases."""
    rows, _ = prepare.prepare_rows(cases(spark, sf_dir), CASES)
    found = profile.build_profile(rows, CASES)
    return spark.createDataFrame([(found["genes"]["objectives"], found["genes"]["exclude"], found["rows"])], "objectives array<string>, exclude array<string>, rows long")


QUERIES = {
    "profile_stats": profile_stats, "profile_text": profile_text, "profile_top_levels": profile_top_levels, "leak_check": leak_check, "profile_totals": profile_totals,
    "profile_trend": profile_trend, "profile_acf": profile_acf, "profile_season": profile_season, "profile_lead_lag": profile_lead_lag, "profile_best_lead": profile_best_lead,
    "profile_censored": profile_censored, "profile_zero_shares": profile_zero_shares, "profile_genes": profile_genes,
}

_WEEK = """f AS (SELECT date_trunc('week', o_orderdate)::DATE AS step, o_orderpriority AS series, sum(o_totalprice) AS y, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
s AS (SELECT series, min(step) AS a, max(step) AS b FROM f GROUP BY 1), g AS (SELECT series, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY))::DATE AS step FROM s),
w AS (SELECT series, step, coalesce(y, 0) AS y, coalesce(n, 0) AS n FROM g LEFT JOIN f USING (series, step)),
t AS (SELECT row_number() OVER (ORDER BY step) - 1 AS pos, sum(y) AS v FROM w GROUP BY step)"""
_ACF = f"""WITH {_WEEK}, l AS (SELECT regr_slope(v, pos) AS m, regr_intercept(v, pos) AS c, count(*) AS k FROM t), d AS (SELECT pos, v - m * pos - c AS v FROM t, l),
a AS (SELECT y.pos - x.pos AS lag, sum(x.v * y.v) / (SELECT sum(v * v) FROM d) AS acf FROM d x JOIN d y ON y.pos > x.pos WHERE y.pos - x.pos < (SELECT least(60, k // 2) FROM l) GROUP BY 1)"""
_LEAD = f"""WITH {_WEEK}, q AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY step) AS pos, y - lag(y) OVER (PARTITION BY series ORDER BY step) AS dy, n - lag(n) OVER (PARTITION BY series ORDER BY step) AS dm FROM w),
ll AS (SELECT b.pos - a.pos AS lag, count(*) AS n, corr(a.dm, b.dy) AS corr FROM q a JOIN q b ON a.series = b.series AND b.pos - a.pos BETWEEN 1 AND 26 AND a.dm IS NOT NULL AND b.dy IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)"""


def _stats(col: str) -> str:
    return f"SELECT '{col}' AS \"column\", round(1 - count({col}) / count(*)::DOUBLE, 4) AS missing, round(avg({col}), 4) AS mean, round(stddev_pop({col}), 4) AS std, round(min({col}), 4) AS min, round(max({col}), 4) AS max, round(avg(({col} = 0)::INTEGER), 4) AS zeros FROM cases"


def _leak(name: str, expr: str) -> str:
    return f"""SELECT '{name}' AS measure, count(*) AS n, round(stddev_pop({expr} - weeks) / stddev_pop(weeks), 5) AS gap_ratio, round(corr({expr}, weeks), 5) AS correlation,
CASE WHEN stddev_pop({expr} - weeks) <= 0.01 * stddev_pop(weeks) THEN 'constant gap' WHEN abs(corr({expr}, weeks)) >= 0.99 THEN 'correlation' END AS reason FROM cases WHERE weeks IS NOT NULL"""


ORACLES = {
    "profile_stats": f"WITH {CASES_SQL} {_stats('o_totalprice')} UNION ALL {_stats('weeks')}",
    "profile_text": "SELECT 'o_orderpriority' AS \"column\", 0.0::DOUBLE AS missing, count(DISTINCT o_orderpriority) AS levels FROM orders UNION ALL SELECT 'o_orderstatus', 0.0::DOUBLE, count(DISTINCT o_orderstatus) FROM orders",
    "profile_top_levels": """WITH p AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS level FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders)
SELECT "column", (row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, level DESC))::INTEGER AS rank, level, count(*) AS n FROM p GROUP BY 1, level QUALIFY rank <= 5""",
    "leak_check": f"WITH {CASES_SQL} {_leak('plus', '(weeks + 1)')} UNION ALL {_leak('scaled', '(weeks * 3 + o_orderkey % 3)')} UNION ALL {_leak('fair', 'o_totalprice')}",
    "profile_totals": f"WITH {PANEL_SQL} SELECT step, row_number() OVER (ORDER BY step) - 1 AS pos, round(sum(y), 2) AS total FROM panel GROUP BY step",
    "profile_trend": f"WITH {PANEL_SQL}, t AS (SELECT row_number() OVER (ORDER BY step) - 1 AS pos, sum(y) AS v FROM panel GROUP BY step) SELECT count(*) AS steps, round(avg(v), 1) AS mean_total, round(regr_slope(v, pos), 2) AS slope, round(regr_slope(v, pos) / avg(v), 6) AS trend_per_step FROM t",
    "profile_acf": f"{_ACF} SELECT lag, round(acf, 6) AS acf FROM a",
    "profile_season": f"""{_ACF}, z AS (SELECT *, lag(acf) OVER (ORDER BY lag) AS p, lead(acf) OVER (ORDER BY lag) AS x FROM a), dip AS (SELECT min(lag) AS low FROM z WHERE p IS NOT NULL AND x IS NOT NULL AND acf <= x)
SELECT (SELECT lag FROM z, dip WHERE lag > low AND acf >= p AND acf >= x AND lag >= 4 ORDER BY acf DESC, lag DESC LIMIT 1) AS period, (SELECT round(max(acf), 6) FROM z, dip WHERE lag > low AND acf >= p AND acf >= x AND lag >= 4) AS strength""",
    "profile_lead_lag": f"{_LEAD} SELECT lag::INTEGER AS lag, n, round(corr, 6) AS corr FROM ll",
    "profile_best_lead": f"{_LEAD} SELECT lag::INTEGER AS lag, round(corr, 6) AS corr, n FROM ll ORDER BY abs(corr) DESC, lag LIMIT 1",
    "profile_censored": "SELECT round(count(DISTINCT o_custkey) / count(*)::DOUBLE, 8) AS censored FROM orders",
    "profile_zero_shares": f"WITH {_WEEK}, z AS (SELECT avg((y = 0)::INTEGER) AS z FROM w GROUP BY series) SELECT count(*) AS series, round(median(z), 6) AS median, round(max(z), 6) AS max FROM z",
    "profile_genes": "SELECT ['squared', 'absolute', 'aft'] AS objectives, []::VARCHAR[] AS exclude, count(*) AS rows FROM orders",
}
