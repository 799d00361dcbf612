"""What the training-data operators share: tables, durable intermediate results, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local master (as in tests) gets a
    folder of its own; on a cluster it is an error, since each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    checkpoint_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoint_dir.isDefined():
        return checkpoint_dir.get()
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-docweir-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def is_local(master: str) -> bool:
    """Whether the driver's process runs the tasks too."""
    return master == "local" or master.startswith("local[")


#: Paths that cut() has written inside the scratch() blocks that are open, the innermost last.
_open: list[list[str]] = []


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read back, and where it lies."""
    path = f"{shared_dir(df.sparkSession)}/docweir-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there and no later job computes it again."""
    out, path = write_table(df)
    if _open:
        _open[-1].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what cut() has written inside: what is made of it must be written by write_table() by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_table(spark, path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files: they go when the table is written, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Rows that a Python function handles at once, and of an Arrow batch: ten thousand long texts would be too many.
SLICE_ROWS = 512
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold SLICE_ROWS rows at most from now on; a smaller bound of the session's own stays."""
    if not 0 < int(spark.conf.get(BATCH)) <= SLICE_ROWS:
        spark.conf.set(BATCH, SLICE_ROWS)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, which bounds the Python objects alive at once; slicing copies nothing."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], added: str, keep: list[str], rows: int = SLICE_ROWS) -> DataFrame:
    """Add columns by a function of a slice of an Arrow batch.

    fn returns the new columns, one value per row; keep names the input columns that stay. An added column replaces a
    kept one of the same name.
    """
    new = T._parse_datatype_string(added) if isinstance(added, str) else added
    names = {f.name for f in new.fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(new.fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema, timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            made = fn(batch)
            columns = []
            for field in target:
                if field.name in names:
                    value = made[field.name]
                    columns.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
                else:
                    columns.append(batch.column(field.name))
            yield pa.RecordBatch.from_arrays(columns, names=target.names)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def blocks(df: DataFrame, weigh: Callable[[object], int], limit: int) -> Iterator[list]:
    """Rows of df in lists whose weights add up to limit or one row more; the driver holds one such list at a time."""
    held, total = [], 0
    for row in df.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        total += weigh(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def gapless(df: DataFrame, within: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without bringing a group into one task.

    Rows are dealt by ranges of (within, order); each range counts its rows for each group; the counts of the ranges
    before it are its offset. The counts are one row for each pair of range and group that meet, which are at most
    ranges + groups. order must be a total order for the numbering to be determined; rows equal in it are parted by their
    place in the input, so that a row repeated very often spreads over many ranges. Nulls sort first.
    """
    from pyspark.sql import Window as W

    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumn("_dw_place", F.monotonically_increasing_id())
    dealt = cut(placed.repartitionByRange(n, *within, *order, "_dw_place").withColumn("_dw_range", F.spark_partition_id()))
    counts = dealt.groupBy("_dw_range", *within).agg(F.count(F.lit(1)).alias("_dw_n"))
    before = W.partitionBy(*within).orderBy("_dw_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_dw_range", *within, F.coalesce(F.sum("_dw_n").over(before), F.lit(0)).alias("_dw_at"))
    number = F.row_number().over(W.partitionBy("_dw_range", *within).orderBy(*order, "_dw_place")) - 1
    numbered = dealt.withColumn("_dw_in", number)
    condition = numbered["_dw_range"] == offsets["_dw_range"]
    for c in within:
        condition = condition & numbered[c].eqNullSafe(offsets[c])
    return numbered.join(offsets, condition).select(
        *(numbered[c] for c in df.columns), (numbered["_dw_in"] + offsets["_dw_at"]).cast("long").alias(out)
    )
