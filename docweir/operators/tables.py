"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local master gets one of its own and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-docweir-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Bytes of an Arrow batch, and of the slice of one that a Python function has as objects at once.
BATCH_BYTES, SLICE_BYTES = 2_000_000, 500_000
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES or one row from now on, so that what a worker holds doesn't grow with a
    table until it has ten thousand texts; a smaller bound of the session's own stays."""
    if not 0 < int(spark.conf.get(BYTES).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(BYTES, str(BATCH_BYTES))


def batched(df: DataFrame) -> DataFrame:
    """df, to be mapped by a Python function in bounded batches."""
    bound_batches(df.sparkSession)
    return df


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_BYTES or one row, for functions that make many objects of each row; slicing copies nothing."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: no later job computes it again, and a lost executor costs nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/docweir-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
