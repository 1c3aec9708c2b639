"""Helpers that several operators use: the shared folder and ASCII white space."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyforge.ship import ship
from tallyforge.sources.shared import written

#: Rows in an Arrow batch of whole texts, unless the session says otherwise; Spark's default is ten times as many.
BATCH_ROWS = 1000
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

#: White space as all word and copy rules here mean it, for Java and RE2 regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(df: DataFrame, stored: bool = False) -> tuple[DataFrame, str]:
    """``df`` with a column, whose name is given too, that tells its rows apart and is the same whenever it is read.

    Where ``df`` is ``stored``, that is plain rows of Parquet files, it is the row's place in its file, with a
    64-bit number of the file's path; else ``df`` is stored once with numbers.
    """
    row = free_name(df, "__row")
    if stored:
        try:
            return df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), row
        except AnalysisException:  # rows that no file holds
            pass
    return written(df.withColumn(row, F.monotonically_increasing_id())), row


def named(id_col: str, row: str) -> Column:
    """What orders the rows of a ``numbered`` table and tells each apart: by id, missing ids last, then by row."""
    return F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col(row).alias("row"))


def with_id(docs: DataFrame, id_col: str, rest: str) -> StructType:
    """The columns ``rest`` (``name type, ...``) after a column ``id`` of the type that ids have in ``docs``."""
    return StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL(rest)])


def fragments_of(spark: SparkSession) -> int:
    """As many parts as the cluster deals a shuffle into, which its owner sets to fit the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ready(spark: SparkSession) -> None:
    """Ships the package and, where the session has Spark's default, makes Arrow batches small enough for long texts."""
    ship(spark)
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
