"""Session settings for local runs, and the shared folder for cut points."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leadline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back on a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    own = tempfile.mkdtemp(prefix="leadline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several later jobs. A written table survives the
    loss of executors, keeps Parquet statistics for the optimizer and has a row
    count in its footers.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(spark: SparkSession, old: str, df: DataFrame, schema: str) -> tuple[str, DataFrame]:
    """Write ``df``, which is made from the table at ``old``, and delete that table.

    For loops that store a state of the same size again and again.
    """
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(old)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return path, spark.read.schema(schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package; a cluster installs it or ships it."""
    root, seen = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = seen.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        seen["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
