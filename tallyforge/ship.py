"""Makes this package importable for Python workers wherever they run."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _archive() -> str:
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, Path(package.name) / source.relative_to(package))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark application."""
    if not any(f.endswith(f"/{Path(_archive()).name}") for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(_archive())


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` (whose first argument is the session), with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return query(spark, *rest)

    return run
