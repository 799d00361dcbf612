"""Commits of a table that lies in buckets: small files that name each bucket's directory.

A manifest is written beside its place and then moved there, which file systems do as one step, so a reader sees a whole
commit or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Manifests that stay, so that a reader of the last but one can finish.
KEPT = 2


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _files(spark, f"{root}/manifests")
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def fresh(root: str, batch: int) -> str:
    """A directory for a batch's buckets that no other attempt writes to."""
    return f"{root}/data/{batch}-{uuid.uuid4().hex[:12]}"


def last(spark: SparkSession, root: str, batch: int | None = None) -> dict:
    """The manifest of the last commit (up to a batch); before the first one it names nothing."""
    numbers = [n for n in _numbers(spark, root) if batch is None or n <= batch]
    if not numbers:
        return {"batch": -1, "dirs": {}}
    return json.loads(spark.read.text(f"{root}/manifests/{numbers[-1]}.json", wholetext=True).first()[0])


def read(spark: SparkSession, manifest: dict, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the buckets that a manifest names, or of some of them."""
    dirs = [d for b, d in manifest["dirs"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*dirs) if dirs else spark.createDataFrame([], schema)


def commit(spark: SparkSession, root: str, manifest: dict) -> None:
    """Put the manifest in its place; an error if its batch has been committed already."""
    fs, at = _files(spark, f"{root}/manifests/{manifest['batch']}.json")
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/.{manifest['batch']}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    if fs.exists(at) or not fs.rename(beside, at):
        fs.delete(beside, False)
        raise FileExistsError(f"batch {manifest['batch']} has been committed")


def sweep(spark: SparkSession, root: str) -> None:
    """Delete all but the last manifests, and the bucket directories that these don't name."""
    numbers = _numbers(spark, root)
    named = set()
    for n in numbers[-KEPT:]:
        named |= {d.removeprefix(f"{root}/data/") for d in last(spark, root, n)["dirs"].values()}
    for n in numbers[:-KEPT]:
        fs, at = _files(spark, f"{root}/manifests/{n}.json")
        fs.delete(at, False)
    fs, at = _files(spark, f"{root}/data")
    for attempt in fs.listStatus(at) if fs.exists(at) else []:
        folder = attempt.getPath().getName()
        held = [x.getPath() for x in fs.listStatus(attempt.getPath()) if x.getPath().getName().startswith("bucket=")]
        stale = [p for p in held if f"{folder}/{p.getName()}" not in named]
        if len(stale) == len(held):
            fs.delete(attempt.getPath(), True)
        else:
            for p in stale:
                fs.delete(p, True)
