"""Judgements as a stream: each tile's latest state, kept up as events arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.sets import fold_judgements
from tallyforge.sources.shared import written


def latest_judgements(events: DataFrame) -> DataFrame:
    """A streaming aggregate of ``tile, at, action, label`` events with one state row per tile; update mode."""
    last = events.groupBy("tile").agg(F.max(F.struct("at", "action", "label")).alias("e"))
    return last.select("tile", F.col("e.action").alias("action"), F.when(F.col("e.action") == "label", F.col("e.label")).alias("label"))


def fold_into(read_records: Callable[[], DataFrame], write_records: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that folds each batch of events into a table of records."""

    def run(batch: DataFrame, epoch: int) -> None:
        write_records(fold_judgements(batch, read_records()))

    return run


#: What a table of judgements holds of each tile: its latest event, a clearing one too, so that a late event does not bring it back.
STATE = "tile string, at long, action string, label string, bucket int, epoch long"


@dataclass(frozen=True)
class JudgementTable:
    """Each tile's latest event, kept up from a stream, in ``buckets`` of tiles that are rewritten only when touched.

    A bucket's rows lie in a folder for each epoch that touched it; the latest counts. An epoch reads what was there
    before it and writes its own folders anew, so one that comes again after a failure changes nothing, and files of
    untouched buckets stay as they are. Of a batch only one event for each tile is moved.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _versions(self) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(STATE).parquet(self.path) if there else self.spark.createDataFrame([], STATE)

    def state(self, before: int | None = None) -> DataFrame:
        """All tiles' latest events, as they were before an epoch where one is given."""
        rows = self._versions() if before is None else self._versions().where(F.col("epoch") < before)
        latest = rows.groupBy("bucket").agg(F.max("epoch").alias("epoch"))  # a row for each bucket
        return rows.join(F.broadcast(latest), ["bucket", "epoch"])

    def records(self) -> DataFrame:
        """``tile, label, excluded`` of the tiles that are not cleared, as ``fold_judgements`` has them."""
        return fold_judgements(self.state().select("tile", "at", "action", "label"))

    def fold(self, batch: DataFrame, epoch: int) -> None:
        """A ``foreachBatch`` sink of ``tile, at, action, label`` events."""
        last = lambda rows: rows.groupBy("bucket", "tile").agg(F.max(F.struct("at", "action", "label")).alias("e")).select("bucket", "tile", "e.*")
        bucket = F.pmod(F.xxhash64("tile"), F.lit(self.buckets)).cast("int")
        new = written(last(batch.select("tile", F.col("at").cast("long").alias("at"), "action", "label", bucket.alias("bucket"))))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # a number for each bucket at most
        if touched:
            held = self.state(epoch).where(F.col("bucket").isin(touched)).select(new.columns)
            merged = last(new.unionByName(held)).withColumn("epoch", F.lit(epoch).cast("long"))
            writer = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket", "epoch").parquet(self.path)

    def tidy(self) -> int:
        """Removes the folders of earlier epochs, and says how many there were; for when nobody reads them."""
        jvm, gone = self.spark.sparkContext._jvm, 0
        for r in self._versions().groupBy("bucket").agg(F.max("epoch").alias("latest"), F.collect_set("epoch").alias("epochs")).collect():  # buckets
            for e in r["epochs"]:
                if e < r["latest"]:
                    folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={r['bucket']}/epoch={e}")
                    gone += bool(folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
        return gone


def step_rollup(events: DataFrame, time: str, value: str, dims: list[str], step: str = "1 day", late: str = "7 days") -> DataFrame:
    """A streaming roll-up to steps that closes a step once events can't be late any more; append mode."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, step), *dims)
    return rows.agg(F.sum(value).alias(value), F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("step"), *dims, value, "n")
