"""Tables and specifications that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.spec import Censor, Column as Col, PrepSpec

WEEKS = 7.0
#: Orders by date and priority: a series for each priority.
SERIES = PrepSpec("series", (Col("o_orderdate", "time"), Col("o_orderpriority", "dimension"), Col("o_totalprice", "target", "sum")), step="month", horizon=6)
#: Waiting time to the same customer's next order; the last one is open.
CASES = PrepSpec("row", (Col("o_orderdate", "anchor"), Col("o_orderpriority", "dimension"), Col("o_totalprice", "measure"), Col("weeks", "target")), censor=Censor("week"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases numbered by their key."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gap = F.datediff(F.to_date(F.lead("o_orderdate").over(order)), F.to_date("o_orderdate"))
    return orders(spark, sf_dir).withColumns({"weeks": gap / WEEKS, "__row": F.col("o_orderkey")})


def rounded(rows: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, so that sums in another order agree."""
    doubles = {n for n, t in rows.dtypes if t == "double"}
    return rows.select(*[F.round(c, own.get(c, digits)).alias(c) if c in doubles else F.col(c) for c in rows.columns])


def c(name: str) -> Column:
    return F.col(name)


#: SQL of the monthly panel and of the cases, for the oracles.
PANEL_SQL = """
facts AS (SELECT date_trunc('month', o_orderdate)::DATE AS step, o_orderpriority AS series, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
ends AS (SELECT series, min(step) AS a, max(step) AS b FROM facts GROUP BY 1),
grid AS (SELECT series, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS step FROM ends),
panel AS (SELECT step, series, coalesce(y, 0) AS y FROM grid LEFT JOIN facts USING (series, step))"""
CASES_SQL = """
cases AS (SELECT *, o_orderdate::DATE AS anchor,
  date_diff('day', o_orderdate::DATE, (lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::DATE) / 7.0::DOUBLE AS weeks FROM orders)"""
