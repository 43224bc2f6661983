"""What the operators share: reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so no other column of ``docs`` can clash; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many texts at most, as some are long and a Python worker holds a whole batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of some ``most`` bytes of text: short ones are put together, long ones cut, a row is whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            stop = min(max(int(np.searchsorted(ends, before + most - size, side="right")), at + (not held)), len(ends))
            if stop > at:
                held.append(b.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at = stop
            if at < len(ends):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session whose executors live in the driver's process may go without: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and there whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tesserae/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path) if not partition_by else df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def thinned(rows: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """About ``size`` of the rows, those whose hash of the id is under a bound; all, if there are no more.

    The bound comes from a count, so no task gathers rows of all others to find the smallest. With so many rows that
    ``size`` are a sample, their number is ``size`` give or take a few of its square root.
    """
    total = rows.count()
    return rows if total <= size else rows.where(_under(F.lit(size / total), id_col))


def thinned_each(rows: DataFrame, size: int, by: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """As ``thinned``, about ``size`` rows for each value of ``by``, of the ``most`` values that have most rows."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), by).limit(most)
    shares = counts.select(F.col(by).alias("_by"), F.least(F.lit(1.0), F.lit(float(size)) / F.col("_n")).alias("_share"))
    # ``most`` rows at most are sent.
    return rows.join(F.broadcast(shares), F.col(by) == F.col("_by")).where((F.col("_share") >= 1) | _under(F.col("_share"), id_col)).drop("_by", "_share")


def _under(share: Column, id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < share * float(1 << 40)


#: The most ids that a join may broadcast: 16 MB.
MOST_SENT = 1_000_000


def selected(docs: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids`` (written, without nulls), or the others.

    A million ids or fewer go to the rows; more are joined by shuffling both.
    """
    named = ids.select(F.col("doc_id").alias("_chosen"))  # told from a column of ``docs`` by its table
    if ids.count() <= MOST_SENT:
        named = F.broadcast(named)
    return docs.join(named, docs["doc_id"] == named["_chosen"], "left_semi" if keep else "left_anti")


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    jvm, own = spark.sparkContext._jvm, f"{shared_folder(spark)}/tesserae/"
    tail = own.split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if tail in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
