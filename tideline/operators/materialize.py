"""Cut points in a plan and consecutive numbering without a single-task window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _checkpoint_dir_ready(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tideline-checkpoint-")  # a local session has one machine
        sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the session's checkpoint folder, which all executors share."""
    _checkpoint_dir_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the session's checkpoint folder and restart the lineage."""
    _checkpoint_dir_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table below the checkpoint folder: read by column, and with a size that joins can plan on."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_id") -> DataFrame:
    """Consecutive 1-based numbers in the given (total) order.

    A global sort is range-partitioned, so each task numbers its own part; the
    parts' sizes (one row per task) give the offsets. The sorted rows are cut
    first: the numbers must not depend on a re-sampled range partitioning.
    """
    local = 1 << 33  # monotonically_increasing_id keeps the row number in the low 33 bits
    parts = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_mid", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        parts.join(F.broadcast(sizes), "_part")  # one row per task of the sort
        .withColumn(name, F.col("_offset") + F.pmod(F.col("_mid"), F.lit(local)) + 1)
        .drop("_part", "_mid", "_offset")
    )
