"""Intermediate tables in the folder that driver and executors share, and row positions by way of them."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and all runs on one machine, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of the runs that are going on, the innermost last.
_RUNS: list[str] = []


def table_folder(spark: SparkSession) -> str:
    """The folder of the run that is going on, else the shared folder."""
    return _RUNS[-1] if _RUNS else shared_folder(spark).rstrip("/")


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path there that nobody else has."""
    return f"{table_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def own_tables(spark: SparkSession):
    """A run with a folder of its own for all intermediate tables, which goes with them at its end, also when it fails.

    What a run gives has to be stored elsewhere or used up within it, since its rows are read from these tables.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ordered(rows: DataFrame, order: list[Column | str] | None) -> DataFrame:
    """``rows`` stored in range partitions sorted by ``order``, with partition ``__cut`` and place in it ``__at``."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    at = F.monotonically_increasing_id()
    return written(placed.withColumns({"__cut": F.shiftright(at, 33), "__at": at.bitwiseAND((1 << 33) - 1)}))


def _before(stored: DataFrame, weight: Column) -> DataFrame:
    """``__cut, __before``: the weight in the partitions before each; one small row per partition."""
    before = Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = stored.groupBy("__cut").agg(F.sum(weight).alias("__n"))
    return F.broadcast(cuts.select("__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))


def with_places(rows: DataFrame, order: list[Column | str] | None, name: str) -> DataFrame:
    """``rows`` with each row's place from 0, as column ``name``: in ``order``, else in the order in which they are read.

    Rows are range-partitioned by the order, sorted within partitions and stored; a partition's rows count on from
    those of the partitions before it, whose counts are one small row each.  Nothing leaves the JVM.
    """
    stored = _ordered(rows, order)
    return stored.join(_before(stored, F.lit(1)), "__cut").withColumn(name, F.col("__at") + F.col("__before")).select(*rows.columns, name)


def with_running(rows: DataFrame, order: list[Column | str], weight: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows before each in ``order``, as column ``name``.

    Like ``with_places``; the windows run within range partitions, whose rows are as many as Spark's sampling deals them.
    """
    stored = _ordered(rows, order)
    within = Window.partitionBy("__cut").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col("__before")
    return stored.join(_before(stored, F.col(weight)), "__cut").withColumn(name, running).select(*rows.columns, name)
