"""What a session needs before lineage can be cut; tables computed once, and rows dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> None:
    """Take the cluster's folder; only a session within one process may go without and gets a temporary one."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
    spark.sparkContext.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the checkpoint folder, so that joins know its size; persisted where a cluster has no such folder."""
    spark = df.sparkSession
    try:
        with_checkpoints(spark)
    except RuntimeError:
        return df.persist()
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a table dealt out by ``key`` where a few tasks would read most of them, as of a file that is one row group.

    A task gives its number of rows alone, which Parquet tells without reading a column.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return rows.repartition(4 * cores, key) if max(held, default=0) * cores > 2 * sum(held) else rows
