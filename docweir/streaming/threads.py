"""Conversation threads kept as state: citations without repeats, counts, and where an interrupted thread goes on."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What happens in a thread: step numbers its events from 1 on; kind is message, tool, citation or done.
EVENTS = "thread_id string, step long, at timestamp, kind string, document_id string, chunk_id string, source_url string"
#: A thread after a batch that it had events in, or after its timer.
THREADS = "thread_id string, status string, last_step long, n_messages long, n_tools long, n_resumed long, citations array<struct<document_id:string,chunk_id:string,source_url:string>>"
IDENTITY = ["document_id", "chunk_id", "source_url"]


class Thread(StatefulProcessor):
    """The state of one thread: a value of counts, a list of citations in the order of their first place, and a map of those seen.

    An event whose step isn't beyond the last one has been handled before and changes nothing, so a thread that is driven
    again from its last step goes on where it stood. Without an event for idle_ms it is interrupted; the next one
    resumes it. keep_ms after the last event its state goes.
    """

    def __init__(self, idle_ms: int, keep_ms: int) -> None:
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "status string, last_step long, n_messages long, n_tools long, n_resumed long, last_ms long")
        self.citations = handle.getListState("citations", "document_id string, chunk_id string, source_url string")
        self.seen = handle.getMapState("seen", "identity string", "at long")

    def _row(self, key: tuple, counts: tuple) -> pd.DataFrame:
        held = [dict(zip(IDENTITY, c, strict=True)) for c in self.citations.get()] if self.citations.exists() else []
        columns = ["status", "last_step", "n_messages", "n_tools", "n_resumed"]
        return pd.DataFrame([{"thread_id": key[0]} | dict(zip(columns, counts, strict=False)) | {"citations": held}])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, last, messages, tools, resumed, at = self.counts.get() if self.counts.exists() else ("running", 0, 0, 0, 0, 0)
        for part in rows:
            for r in part.sort_values(["step", "kind"]).itertuples():
                if r.step <= last:
                    continue
                if status == "interrupted":
                    status, resumed = "running", resumed + 1
                last, at = int(r.step), max(at, int(r.at.timestamp() * 1000))
                messages, tools = messages + (r.kind == "message"), tools + (r.kind == "tool")
                if r.kind == "citation":
                    cited = tuple(None if pd.isna(x) else x for x in (r.document_id, r.chunk_id, r.source_url))
                    identity = (json.dumps(cited),)
                    if not self.seen.containsKey(identity):
                        self.seen.updateValue(identity, (last,))
                        self.citations.appendValue(cited)
                status = "done" if r.kind == "done" else "running"
        counts = (status, last, messages, tools, resumed, at)
        self.counts.update(counts)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if status == "running":
            self.handle.registerTimer(at + self.idle_ms)
        self.handle.registerTimer(at + self.keep_ms)
        yield self._row(key, counts)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.counts.exists():
            return
        counts = self.counts.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= counts[5] + self.keep_ms:
            for held in (self.counts, self.citations, self.seen):
                held.clear()
        elif counts[0] == "running":
            counts = ("interrupted", *counts[1:])
            self.counts.update(counts)
            yield self._row(key, counts)

    def close(self) -> None:
        pass


def threads(events: DataFrame, idle: str = "10 minutes", keep: str = "7 days", late: str = "1 minute") -> DataFrame:
    """Threads (THREADS) as a stream of EVENTS changes them, in update mode; idle and keep run in event time. The session's
    state store must hold large states: see start()."""
    span = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    keyed = events.withWatermark("at", late).groupBy("thread_id")
    return keyed.transformWithStateInPandas(Thread(span(idle), span(keep)), THREADS, "Update", "EventTime")


def start(events: DataFrame, root: str, **how: str) -> StreamingQuery:
    """Keep the threads of a stream: each batch's rows go to a directory of its own, so one that runs again writes them again.

    A query that is started again goes on from its checkpoint, with all threads as they were.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/threads/number={number}")

    writer = threads(events).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**(how or {"availableNow": True})).start()


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The threads as the last batch that changed each left them, from which an interrupted one goes on."""
    rows = spark.read.parquet(f"{root}/threads").drop("number")
    return rows.groupBy("thread_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("thread_id", "batch"))), F.struct("batch", "last_step")).alias("r")).select("thread_id", "r.*")


def recount(events: DataFrame) -> DataFrame:
    """What the threads of a finished table of EVENTS come to, in one batch, where each thread's steps came in order."""
    once = events.groupBy("thread_id", "step").agg(F.min_by(F.struct("kind", *IDENTITY), "kind").alias("r")).select("thread_id", "step", "r.*")
    cited = once.filter("kind = 'citation'").groupBy("thread_id", *IDENTITY).agg(F.min("step").alias("at"))
    listed = cited.groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(*IDENTITY).alias("c")))), lambda x: x["c"]).alias("citations"))
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    counted = once.groupBy("thread_id").agg(F.max("step").alias("last_step"), n("message").alias("n_messages"), n("tool").alias("n_tools"), F.max_by("kind", "step").alias("_k"))
    met = counted.join(listed, "thread_id", "left")
    none = F.array().cast("array<struct<document_id:string,chunk_id:string,source_url:string>>")
    return met.select("thread_id", F.when(F.col("_k") == "done", "done").otherwise("running").alias("status"), "last_step", "n_messages", "n_tools", F.coalesce("citations", none).alias("citations"))


def resumed(states: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages (thread_id, step, ...) that came after their thread's last step, which are still to be handled."""
    held = states.select(F.col("thread_id").alias("_t"), F.col("last_step").alias("_s"))
    met = messages.join(held, messages["thread_id"] == held["_t"], "left")
    return met.filter(F.col("_s").isNull() | (F.col("step") > F.col("_s"))).drop("_t", "_s")
