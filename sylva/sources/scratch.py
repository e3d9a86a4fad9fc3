"""Node tables that a query uses more than once, shredded once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a local one only for a local master that names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/forest-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, folder in _made:
        with contextlib.suppress(Exception):  # the session may be gone
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark then drops the shuffle files of a write when it has ended, instead of whenever the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(forest: DataFrame) -> DataFrame:
    """``forest`` (or its documents) written to the shared folder and read again.

    Each use then scans the columns and rows that it asks for, which no plan can push
    into the shredder; a lost executor costs no second shredding.  The files go when the
    driver ends, what was shuffled to write them goes at once.
    """
    spark = forest.sparkSession
    path, before = _folder(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        forest.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(forest.schema).parquet(path)
