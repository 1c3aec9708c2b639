"""Preparation, splits and features."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import features, splits
from tallyforge.plans import prepare
from tallyforge.queries.common import CASES, CASES_SQL, PANEL_SQL, SERIES, c, cases, orders, rounded, table
from tallyforge.sources import files
from tallyforge.sources.shared import new_path
from tallyforge.spec import Column, PrepSpec

CUT = dt.date(1997, 1, 1)


def _panel(step):
    def run(spark, sf_dir):
        rows = prepare.panel(orders(spark, sf_dir), replace(SERIES, step=step))
        return rounded(rows.select(c("__step").alias("step"), c("__series").alias("series"), "o_orderpriority", "o_totalprice"), 2)

    return run


def _panel_sql(step, interval):
    return f"""
WITH f AS (SELECT date_trunc('{step}', o_orderdate)::DATE AS step, o_orderpriority, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
g AS (SELECT p.o_orderpriority, d.step FROM (SELECT o_orderpriority, min(step) AS a, max(step) AS b FROM f GROUP BY 1) p
      JOIN (SELECT unnest(generate_series((SELECT min(step) FROM f)::TIMESTAMP, (SELECT max(step) FROM f)::TIMESTAMP, INTERVAL {interval}))::DATE AS step) d ON d.step BETWEEN p.a AND p.b)
SELECT g.step, g.o_orderpriority AS series, g.o_orderpriority, round(coalesce(f.y, 0), 2) AS o_totalprice FROM g LEFT JOIN f USING (step, o_orderpriority)"""


AGGS = ("sum", "mean", "min", "max", "count", "last")


def prep_agg_all(spark, sf_dir):
    """Every aggregation of the order value per month and customer, with gaps filled by each one's rule."""
    rows = orders(spark, sf_dir).withColumns({a: c("o_totalprice") for a in AGGS})
    spec = PrepSpec("series", (Column("o_orderdate", "time"), Column("o_custkey", "dimension"), *[Column(a, "measure", a) for a in AGGS[:-1]], Column("last", "target", "last")), step="month", where="o_totalprice > 1000", extra={"order": ("o_orderkey",)})
    out = prepare.panel(rows, spec)
    return rounded(out.select(c("__step").alias("step"), "o_custkey", *[c(a).cast("double").alias("v_" + a) for a in AGGS]), 2, v_mean=6)


def prep_scaffold(spark, sf_dir):
    return prepare.scaffold(orders(spark, sf_dir), SERIES).select(c("__step").alias("step"), c("__series").alias("series"), "o_orderpriority")


def prep_infer_step(spark, sf_dir):
    """The step inferred from all order dates and from those of the month's first day."""
    rows = orders(spark, sf_dir)
    first = prepare.infer_step(rows, "o_orderdate").withColumn("of", F.lit("all"))
    return first.unionByName(prepare.infer_step(rows, "o_orderdate", "day(o_orderdate) = 1").withColumn("of", F.lit("firsts")))


def prep_history(spark, sf_dir):
    """Steps before the one that holds the export date, in a table cut in the middle of a month."""
    spec = replace(SERIES, as_of="1997-05-17")
    return rounded(prepare.grouped_steps(orders(spark, sf_dir), spec, "month").select(c("__step").alias("step"), "o_orderpriority", "o_totalprice"), 2)


def prep_series_summary(spark, sf_dir):
    return prepare.series_summary(orders(spark, sf_dir), replace(SERIES, as_of="1997-05-17"))


def row_bounds(spark, sf_dir):
    rows, _ = prepare.prepare_rows(cases(spark, sf_dir), CASES)
    return rounded(rows.select(c("__row").alias("row"), c("__anchor").alias("anchor"), "o_orderpriority", "o_totalprice", "weeks", c("__lower").alias("lower"), c("__upper").alias("upper")))


def row_predict(spark, sf_dir):
    spec = replace(CASES, where="o_totalprice > 2000", predict_where="o_orderstatus <> 'F'")
    _, ahead = prepare.prepare_rows(cases(spark, sf_dir), spec)
    return rounded(ahead.select(c("__row").alias("row"), c("__anchor").alias("anchor"), c("__lower").alias("lower")))


def row_summary(spark, sf_dir):
    return prepare.row_summary(cases(spark, sf_dir), replace(CASES, where="o_totalprice > 2000", predict_where="o_orderstatus <> 'F'"))


def row_numbers(spark, sf_dir):
    """Ordinals by a total order, from range partitions."""
    return prepare.numbered(orders(spark, sf_dir).select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", c("__row").alias("row"))


def labels_as_of(spark, sf_dir):
    rows, _ = prepare.prepare_rows(cases(spark, sf_dir), CASES)
    seen = splits.labels_as_of(rows, CUT, 7.0)
    return rounded(seen.select(c("__row").alias("row"), c("__lower").alias("lower"), c("__upper").alias("upper")))


def row_split_masks(spark, sf_dir):
    rows, _ = prepare.prepare_rows(cases(spark, sf_dir), CASES)
    cuts = splits.row_cuts(rows, dt.date(1998, 6, 1))
    return rows.select(c("__row").alias("row"), splits.split_of(c("__anchor"), cuts).alias("split"))


def series_cuts(spark, sf_dir):
    grid = prepare.panel(orders(spark, sf_dir), SERIES)
    return splits.series_cuts(grid, 6).select(c("__step").alias("step"), c("place").cast("long").alias("place"), "split")


def hash_split(spark, sf_dir):
    """How many customers each part of a split by their key's hash gets."""
    drawn = splits.assign(table(spark, sf_dir, "customer"), c("c_custkey"), {"train": 70, "val": 20, "test": 10}, 3)
    return drawn.groupBy("split").agg(F.count("*").alias("n"))


def stamped_split(spark, sf_dir):
    """Orders with the part that their customer is in, stamped on and read back; a second stamp is refused."""
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    path = new_path(spark)
    splits.stamp_split(rows, c("o_custkey"), {"train": 70, "val": 20, "test": 10}, 3).write.parquet(path)
    back = spark.read.parquet(path)
    try:
        splits.stamp_split(back, c("o_custkey"), {"train": 70, "val": 20, "test": 10}, 4)
        refused = False
    except splits.SplitError:
        refused = True
    parts = back.groupBy("split").agg(F.count_distinct("o_custkey").alias("customers"))
    torn = back.groupBy("o_custkey").agg(F.count_distinct("split").alias("n")).agg((F.max("n") == 1).alias("whole"))  # one row
    return parts.join(F.broadcast(torn)).withColumn("refused", F.lit(refused))


def sample_share(spark, sf_dir):
    """Whole customers in a sample of a fifth: the rows that stay, by customer."""
    rows = orders(spark, sf_dir).withColumn("n_all", F.count("*").over(Window.partitionBy("o_custkey")))
    return splits.sampled(rows, c("o_custkey"), 20, 1).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("n_all").alias("n_all"))


def describe_columns(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return files.describe(rows, "row").withColumn("samples", F.array_join("samples", "|"))


def locale_numbers(spark, sf_dir):
    """Prices written with points and a comma, read back."""
    plain = F.format_number("o_totalprice", 2)
    german = F.translate(plain, ",.", ".,")
    rows = orders(spark, sf_dir).select("o_orderkey", german.alias("german"), plain.alias("english"))
    return rounded(files.typed_numbers(rows), 2)


def features_lags(spark, sf_dir):
    base, _ = features.origin_features(prepare.panel(orders(spark, sf_dir), SERIES), SERIES, "month", 2, period=12, with_ewm=False)
    return rounded(base.select(c("__series").alias("series"), c("index").cast("long").alias("index"), "lag_2", "lag_3", "lag_4", "lag_5", "lag_12_season"), 2)


def features_rolling(spark, sf_dir):
    base, _ = features.origin_features(prepare.panel(orders(spark, sf_dir), SERIES), SERIES, "month", 1, with_ewm=False)
    names = [f"roll{w}_{s}" for w in (4, 13) for s in ("mean", "std", "max", "zeros")]
    return rounded(base.select(c("__series").alias("series"), c("index").cast("long").alias("index"), *names), 0)


def features_ewm(spark, sf_dir):
    grid = prepare.panel(orders(spark, sf_dir), SERIES)
    return rounded(features.smoothed(grid, "o_totalprice").select(c("__series").alias("series"), c("__step").alias("step"), c("ewm10").alias("e1"), c("ewm30").alias("e3"), c("ewm50").alias("e5")), 2)


def features_calendar(spark, sf_dir):
    from tallyforge.functions.expressions import calendar, step_index

    days = orders(spark, sf_dir).select(F.to_date("o_orderdate").alias("day")).distinct()
    parts = {k: v.cast("long") for k, v in calendar(c("day")).items()}
    return days.select("day", *[v.alias(k) for k, v in parts.items()], *[step_index(c("day"), s).cast("long").alias("i_" + s) for s in ("day", "week", "month", "quarter", "year")])


def features_bucket_rows(spark, sf_dir):
    """The rows of the bucket of horizons 2 to 4, past and future, with the freshest lag and the calendar."""
    rows = orders(spark, sf_dir)
    grid, ahead = prepare.panel(rows, SERIES), prepare.scaffold(rows, SERIES)
    frame, _ = features.series_features(grid, ahead, SERIES, (2, 4), "month", c("__step") < F.lit(CUT), with_ewm=False)
    return rounded(frame.select("series", "step", "future", "y", "lag_4", "lag_7", "cal_month", "cal_quarter", "o_orderpriority_code"), 2)


def features_rows(spark, sf_dir):
    """Row features: codes and frequencies from training rows, log of a measure, calendar, trend."""
    rows, _ = prepare.prepare_rows(cases(spark, sf_dir), CASES)
    out, _ = features.row_features(rows, c("__anchor") < F.lit(CUT), CASES, ["__row"])
    return rounded(out.withColumnRenamed("__row", "row"), 6)


QUERIES = {
    "prep_panel_month": _panel("month"), "prep_panel_week": _panel("week"), "prep_panel_quarter": _panel("quarter"), "prep_agg_all": prep_agg_all,
    "prep_scaffold": prep_scaffold, "prep_infer_step": prep_infer_step, "prep_history": prep_history, "prep_series_summary": prep_series_summary,
    "row_bounds": row_bounds, "row_predict": row_predict, "row_summary": row_summary, "row_numbers": row_numbers, "labels_as_of": labels_as_of,
    "row_split_masks": row_split_masks, "series_cuts": series_cuts, "hash_split": hash_split, "stamped_split": stamped_split, "sample_share": sample_share, "describe_columns": describe_columns,
    "locale_numbers": locale_numbers, "features_lags": features_lags, "features_rolling": features_rolling, "features_ewm": features_ewm,
    "features_calendar": features_calendar, "features_bucket_rows": features_bucket_rows, "features_rows": features_rows,
}

_LOWER = "CASE WHEN weeks IS NULL THEN date_diff('day', anchor, (SELECT max(o_orderdate)::DATE FROM orders {w})) / 7.0::DOUBLE ELSE weeks END"
_BOUNDS = f"{CASES_SQL}, b AS (SELECT o_orderkey AS row, anchor, o_orderpriority, o_orderstatus, o_totalprice, weeks, {_LOWER.format(w='')} AS lower, coalesce(weeks, 'infinity'::DOUBLE) AS upper FROM cases)"

_COLUMNS = (("o_orderkey", "number", "measure"), ("o_custkey", "number", "measure"), ("o_orderstatus", "text", "dimension"), ("o_totalprice", "number", "measure"), ("o_orderdate", "date", "anchor"), ("o_orderpriority", "text", "dimension"))
_DESCRIBED = """SELECT '{name}' AS "column", '{kind}' AS kind, count(DISTINCT {name}) AS levels, count(*) - count({name}) AS missing,
(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {name}::VARCHAR AS v FROM orders WHERE {name} IS NOT NULL ORDER BY v LIMIT 5)) AS samples, '{role}' AS role FROM orders"""

ORACLES = {
    "prep_panel_month": _panel_sql("month", "1 MONTH"), "prep_panel_week": _panel_sql("week", "7 DAY"), "prep_panel_quarter": _panel_sql("quarter", "3 MONTH"),
    "prep_agg_all": """
WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS step, o_custkey, o_orderdate, o_orderkey, o_totalprice AS v FROM orders WHERE o_totalprice > 1000),
l AS (SELECT step, o_custkey, v AS last FROM s QUALIFY row_number() OVER (PARTITION BY step, o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) = 1),
f AS (SELECT step, o_custkey, sum(v) AS a, avg(v) AS b, min(v) AS c, max(v) AS d, count(v) AS e, any_value(last) AS l FROM s JOIN l USING (step, o_custkey) GROUP BY 1, 2),
g AS (SELECT o_custkey, unnest(generate_series(min(step)::TIMESTAMP, max(step)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS step FROM f GROUP BY 1)
SELECT step, o_custkey::VARCHAR AS o_custkey, round(coalesce(a, 0), 2) AS v_sum, round(b, 6) AS v_mean, round(c, 2) AS v_min, round(d, 2) AS v_max, coalesce(e, 0)::DOUBLE AS v_count,
  round(last_value(l IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY step), 2) AS v_last FROM g LEFT JOIN f USING (step, o_custkey)""",
    "prep_scaffold": """
WITH m AS (SELECT max(date_trunc('month', o_orderdate)) AS last FROM orders)
SELECT (last + to_months(k::INTEGER))::DATE AS step, o_orderpriority AS series, o_orderpriority FROM m, range(1, 7) r(k), (SELECT DISTINCT o_orderpriority FROM orders)""",
    "prep_infer_step": """
WITH d AS (SELECT DISTINCT 'all' AS of, o_orderdate::DATE AS t FROM orders UNION SELECT DISTINCT 'firsts', o_orderdate::DATE FROM orders WHERE day(o_orderdate) = 1),
g AS (SELECT of, date_diff('day', lag(t) OVER (PARTITION BY of ORDER BY t), t) AS gap FROM d),
k AS (SELECT of, median(gap)::DOUBLE AS median_gap FROM g GROUP BY 1)
SELECT of, median_gap, CASE WHEN median_gap IS NULL OR median_gap <= 1.5 THEN 'day' WHEN median_gap <= 8 THEN 'week' WHEN median_gap <= 35 THEN 'month' WHEN median_gap <= 100 THEN 'quarter' ELSE 'year' END AS step FROM k""",
    "prep_history": "SELECT date_trunc('month', o_orderdate)::DATE AS step, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-05-01' GROUP BY 1, 2",
    "prep_series_summary": """
WITH h AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-05-01'),
s AS (SELECT o_orderpriority, min(date_trunc('month', o_orderdate)) AS a, max(date_trunc('month', o_orderdate)) AS b FROM h GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders WHERE o_orderdate IS NULL) AS dropped_null_time, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-01') AS dropped_after_as_of,
  count(*) AS series, sum(date_diff('month', a, b) + 1)::BIGINT AS panel_rows, max(b)::DATE AS as_of, count(*) * 6 AS scaffold_rows, 'month' AS step, 6 AS horizon FROM s""",
    "row_bounds": f"WITH {_BOUNDS} SELECT row, anchor, o_orderpriority, round(o_totalprice, 6) AS o_totalprice, round(weeks, 6) AS weeks, round(lower, 6) AS lower, round(upper, 6) AS upper FROM b",
    "row_predict": f"WITH {CASES_SQL} SELECT o_orderkey AS row, anchor, round({_LOWER.format(w='WHERE o_totalprice > 2000')}, 6) AS lower FROM cases WHERE weeks IS NULL AND o_totalprice > 2000 AND o_orderstatus <> 'F'",
    "row_summary": f"""WITH {CASES_SQL}, f AS (SELECT * FROM cases WHERE o_totalprice > 2000)
SELECT (SELECT count(*) FROM cases) AS source_rows, count(*) AS rows_after_where, count(*) - count(anchor) AS dropped_null_anchor, count(anchor) AS rows, count(*) FILTER (weeks IS NULL) AS open_rows,
  count(weeks) AS known_rows, count(*) FILTER (weeks IS NULL AND o_orderstatus <> 'F') AS predict_rows, max(anchor) AS as_of FROM f""",
    "row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row FROM orders",
    "labels_as_of": f"""WITH {_BOUNDS}, w AS (SELECT *, date_diff('day', anchor, DATE '1997-01-01') / 7.0::DOUBLE AS waited FROM b)
SELECT row, round(CASE WHEN waited < 0 THEN NULL WHEN isfinite(upper) AND lower <= waited THEN lower ELSE greatest(waited, 0) END, 6) AS lower,
  CASE WHEN waited < 0 THEN NULL WHEN isfinite(upper) AND lower <= waited THEN round(upper, 6) ELSE 'infinity'::DOUBLE END AS upper FROM w""",
    "row_split_masks": """
SELECT o_orderkey AS row, CASE WHEN o_orderdate::DATE < DATE '1998-06-01' - 364 THEN 'train' WHEN o_orderdate::DATE < DATE '1998-06-01' - 273 THEN 'val' WHEN o_orderdate::DATE < DATE '1998-06-01' - 182 THEN 'test' END AS split FROM orders""",
    "series_cuts": f"""WITH {PANEL_SQL}, p AS (SELECT DISTINCT step FROM panel), n AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS place, count(*) OVER () AS k FROM p),
v AS (SELECT *, CASE WHEN k - 13 - 26 >= 26 THEN 13 ELSE greatest(6, (k - 26) // 3) END AS t, CASE WHEN k - 13 - 26 >= 26 THEN 39 ELSE k - 26 END AS late FROM n)
SELECT step, place, CASE WHEN place < k - late THEN 'train' WHEN place < k - t THEN 'val' ELSE 'test' END AS split FROM v""",
    "hash_split": """
WITH k AS (SELECT count(DISTINCT c_custkey) AS n FROM customer), s AS (SELECT * FROM (VALUES ('train', 70), ('val', 20), ('test', 10)) t(split, w)),
q AS (SELECT split, n * w // 100 AS base, n * w % 100 AS rest, n, w FROM s, k), x AS (SELECT *, row_number() OVER (ORDER BY rest DESC, w DESC) AS r, sum(base) OVER () AS had FROM q)
SELECT split, (base + CASE WHEN r <= n - had THEN 1 ELSE 0 END)::BIGINT AS n FROM x""",
    "stamped_split": """
WITH k AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), s AS (SELECT * FROM (VALUES ('train', 70), ('val', 20), ('test', 10)) t(split, w)),
q AS (SELECT split, n * w // 100 AS base, n * w % 100 AS rest, n, w FROM s, k), x AS (SELECT *, row_number() OVER (ORDER BY rest DESC, w DESC) AS r, sum(base) OVER () AS had FROM q)
SELECT split, (base + CASE WHEN r <= n - had THEN 1 ELSE 0 END)::BIGINT AS customers, TRUE AS whole, TRUE AS refused FROM x""",
    "sample_share": "SELECT o_custkey, count(*) AS n, count(*) AS n_all FROM orders WHERE ('0x' || substr(md5('1:' || o_custkey), 1, 8))::BIGINT % 100 < 20 GROUP BY 1",
    "describe_columns": " UNION ALL ".join(_DESCRIBED.format(name=name, kind=kind, role=role) for name, kind, role in _COLUMNS),
    "locale_numbers": "SELECT o_orderkey, round(o_totalprice, 2) AS german, round(o_totalprice, 2) AS english FROM orders",
    "features_lags": f"""WITH {PANEL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) AS k FROM panel), x AS (SELECT max(step) AS last FROM panel),
t AS (SELECT series, step, y, k FROM r UNION ALL SELECT series, unnest(generate_series(max(step)::TIMESTAMP + INTERVAL 1 MONTH, (SELECT last FROM x)::TIMESTAMP, INTERVAL 1 MONTH))::DATE, 0, NULL FROM panel GROUP BY series),
z AS (SELECT series, step, y, row_number() OVER (PARTITION BY series ORDER BY step) AS k FROM t)
SELECT a.series, (year(a.step) * 12 + month(a.step) - 1)::BIGINT AS index, round(a.y, 2) AS lag_2, round(b.y, 2) AS lag_3, round(c.y, 2) AS lag_4, round(d.y, 2) AS lag_5, round(e.y, 2) AS lag_12_season
FROM z a LEFT JOIN z b ON b.series = a.series AND b.k = a.k - 1 LEFT JOIN z c ON c.series = a.series AND c.k = a.k - 2 LEFT JOIN z d ON d.series = a.series AND d.k = a.k - 3 LEFT JOIN z e ON e.series = a.series AND e.k = a.k - 10""",
    "features_rolling": f"""WITH {PANEL_SQL}, x AS (SELECT max(step) AS last FROM panel),
t AS (SELECT series, step, y FROM panel UNION ALL SELECT series, unnest(generate_series(max(step)::TIMESTAMP + INTERVAL 1 MONTH, (SELECT last FROM x)::TIMESTAMP, INTERVAL 1 MONTH))::DATE, 0 FROM panel GROUP BY series),
n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) AS k FROM t)
SELECT a.series, (year(a.step) * 12 + month(a.step) - 1)::BIGINT AS index, {", ".join(f"CASE WHEN count(b.y) FILTER (b.k > a.k - {w}) >= {w // 2} THEN round({f}(b.y) FILTER (b.k > a.k - {w}), 0) END AS roll{w}_{s}" for w in (4, 13) for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max")))},
{", ".join(f"CASE WHEN count(b.y) FILTER (b.k > a.k - {w}) >= {w // 2} THEN round(avg((b.y = 0)::INTEGER) FILTER (b.k > a.k - {w}), 0) END AS roll{w}_zeros" for w in (4, 13))}
FROM n a JOIN n b ON b.series = a.series AND b.k BETWEEN a.k - 12 AND a.k GROUP BY a.series, a.step""",
    "features_ewm": f"""WITH RECURSIVE {PANEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) AS k FROM panel),
e AS (SELECT series, step, k, y AS a, y AS b, y AS c FROM n WHERE k = 1 UNION ALL SELECT n.series, n.step, n.k, 0.1 * n.y + 0.9 * e.a, 0.3 * n.y + 0.7 * e.b, 0.5 * n.y + 0.5 * e.c FROM n JOIN e ON n.series = e.series AND n.k = e.k + 1)
SELECT series, step, round(a, 2) AS e1, round(b, 2) AS e3, round(c, 2) AS e5 FROM e""",
    "features_calendar": """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day, ((dayofyear(day) - 1) // 7 + 1)::BIGINT AS week, month(day)::BIGINT AS month, quarter(day)::BIGINT AS quarter, (isodow(day) - 1)::BIGINT AS weekday, date_diff('day', DATE '1970-01-01', day)::BIGINT AS i_day,
  (date_diff('day', DATE '1970-01-05', date_trunc('week', day)::DATE) // 7)::BIGINT AS i_week, (year(day) * 12 + month(day) - 1)::BIGINT AS i_month, (year(day) * 4 + quarter(day) - 1)::BIGINT AS i_quarter, year(day)::BIGINT AS i_year FROM d""",
    "features_bucket_rows": f"""WITH {PANEL_SQL}, m AS (SELECT max(step) AS last FROM panel),
ext AS (SELECT series, step, y FROM panel UNION ALL SELECT series, unnest(generate_series(max(step)::TIMESTAMP + INTERVAL 1 MONTH, (SELECT last FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE, 0 FROM panel GROUP BY series),
code AS (SELECT series, row_number() OVER (ORDER BY series) - 1 AS code FROM (SELECT DISTINCT series FROM panel WHERE step < DATE '1997-01-01')),
rows AS (SELECT series, step, y, FALSE AS future FROM panel UNION ALL SELECT series, (last + to_months(k::INTEGER))::DATE, NULL, TRUE FROM (SELECT DISTINCT series FROM panel), m, range(2, 5) r(k))
SELECT r.series, r.step, r.future, round(r.y, 2) AS y, round(o.y, 2) AS lag_4, round(p.y, 2) AS lag_7, month(r.step)::DOUBLE AS cal_month, quarter(r.step)::DOUBLE AS cal_quarter, code::DOUBLE AS o_orderpriority_code
FROM rows r JOIN ext o ON o.series = r.series AND o.step = (r.step - INTERVAL 4 MONTH)::DATE LEFT JOIN ext p ON p.series = r.series AND p.step = (r.step - INTERVAL 7 MONTH)::DATE LEFT JOIN code ON code.series = r.series""",
    "features_rows": """
WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), l AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, count(*) / (SELECT count(*) FROM t)::DOUBLE AS f FROM t GROUP BY 1)
SELECT o_orderkey AS row, code::DOUBLE AS o_orderpriority_code, round(coalesce(f, 0), 6) AS o_orderpriority_frequency, round(o_totalprice, 6) AS o_totalprice, round(ln(1 + o_totalprice), 6) AS o_totalprice_log,
  ((dayofyear(o_orderdate) - 1) // 7 + 1)::DOUBLE AS anchor_week, month(o_orderdate)::DOUBLE AS anchor_month, quarter(o_orderdate)::DOUBLE AS anchor_quarter, (isodow(o_orderdate) - 1)::DOUBLE AS anchor_weekday,
  round(date_diff('day', (SELECT min(o_orderdate)::DATE FROM t), o_orderdate::DATE) / 365.25, 6) AS anchor_years FROM orders LEFT JOIN l USING (o_orderpriority)""",
}
