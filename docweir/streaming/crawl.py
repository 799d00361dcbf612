"""Crawl results merged as they arrive, and conversations counted as they go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import canonical
from ..operators import merge
from . import manifest

CRAWLED = "url string, ordinal long, title string, markdown string"
MESSAGES = "conv_id long, turn long, role string, text string, at timestamp"


def crawl_stream(spark: SparkSession, folder: str, files_per_batch: int = 5) -> DataFrame:
    """Crawled documents from JSON files as they come into a folder."""
    return spark.readStream.schema(CRAWLED).option("maxFilesPerTrigger", files_per_batch).json(folder)


#: Buckets that a crawl's state is dealt to by its urls; a batch rewrites those that its urls fall into.
BUCKETS = 256


def merge_batches(root: str, now: Callable[[int], str] = lambda batch: "2024-01-01", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the state and appends its history.

    The state lies in buckets by a hash of the url. A batch reads and rewrites the buckets that its urls fall into, beside the
    old ones, and then commits a manifest that names the directory of every bucket; a batch that fails before that has changed
    nothing, and one that is run again after its commit does nothing. Directories that neither the last manifest nor
    the one before names are deleted with the next commit, so disk follows the corpus and not the number of batches.
    mark_missing isn't for batches, which see a part of the pages each.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = manifest.last(spark, root, number)
        if known["batch"] == number:
            return
        of_url = lambda url: F.pmod(F.xxhash64(url), F.lit(known.get("buckets_n", buckets))).cast("int")
        batch = batch.persist()
        try:
            touched = sorted(r.b for r in batch.select(of_url(canonical(F.col("url"))).alias("b")).distinct().collect() if r.b is not None)
            before = manifest.read(spark, known, merge.STATE, touched)
            merged = merge.sync(before, batch, F.lit(now(number)).cast("timestamp")).withColumn("bucket", of_url("canonical_url"))
            folder = manifest.fresh(root, number)
            merged.repartition(max(1, min(len(touched), 64)), "bucket").write.partitionBy("bucket").parquet(folder)
        finally:
            batch.unpersist()
        again = spark.read.schema(f"{merge.STATE}, change string, bucket int").parquet(folder) if touched else spark.createDataFrame([], f"{merge.STATE}, change string")
        versions = f"{root}/versions/batch={number}"
        merge.new_versions(again).write.mode("overwrite").parquet(versions)
        dirs = dict(known["dirs"]) | {str(b): f"{folder}/bucket={b}" for b in touched}
        manifest.commit(spark, root, {"batch": number, "buckets_n": known.get("buckets_n", buckets), "dirs": dirs})
        manifest.sweep(spark, root)

    return run


def state(spark: SparkSession, root: str) -> DataFrame:
    """The state as the last commit has it."""
    return manifest.read(spark, manifest.last(spark, root), merge.STATE)


def start_merging(stream: DataFrame, root: str, buckets: int = BUCKETS, **how: str) -> StreamingQuery:
    """Run merge_batches() over a stream; its checkpoint makes each file count in one batch."""
    writer = stream.writeStream.foreachBatch(merge_batches(root, buckets=buckets)).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**(how or {"availableNow": True})).start()


def history(spark: SparkSession, root: str) -> DataFrame:
    """All versions that the batches added."""
    return spark.read.parquet(f"{root}/versions")


def conversation_counts(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Messages of each conversation and role in a stream (MESSAGES), each (conv_id, turn) counted once within the delay."""
    once = messages.withWatermark("at", late).dropDuplicatesWithinWatermark(["conv_id", "turn"])
    return once.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))


def event_windows(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Beyond parity: events of each type in five-minute windows, late ones within the delay counted."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
