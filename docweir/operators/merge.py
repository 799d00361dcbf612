"""Change-data merges and upserts: current and incoming rows in, merged rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.urls import canonical

STATE = "canonical_url string, title string, content_hash string, current_version int, status string, last_seen timestamp, missing_since timestamp"


def first_of_batch(incoming: DataFrame) -> DataFrame:
    """Of each canonical url the row with the smallest ordinal, with its content hash."""
    keyed = incoming.select(canonical(F.col("url")).alias("canonical_url"), "ordinal", "title", content_hash(F.col("title"), F.col("markdown")).alias("content_hash"))
    first = keyed.groupBy("canonical_url").agg(F.min_by(F.struct("title", "content_hash"), "ordinal").alias("r"))
    return first.select("canonical_url", "r.title", "r.content_hash")


def sync(state: DataFrame, incoming: DataFrame, now: Column, mark_missing: bool = False) -> DataFrame:
    """The state after one crawl batch, with change: added, updated, unchanged, missing or kept.

    A new url starts at version 1; a changed hash raises the version; an equal one refreshes last_seen and brings a
    missing row back. Rows that weren't seen become MISSING only if mark_missing says so.
    """
    new = first_of_batch(incoming).select(F.col("canonical_url").alias("u"), F.col("title").alias("t"), F.col("content_hash").alias("h"))
    both = state.join(new, state["canonical_url"] == new["u"], "full_outer")
    seen, known = F.col("u").isNotNull(), F.col("canonical_url").isNotNull()
    same = F.col("content_hash") == F.col("h")
    lost = known & ~seen & (F.col("status") == "ACTIVE") & F.lit(mark_missing)
    change = F.when(~known, "added").when(seen & ~same, "updated").when(seen, "unchanged").when(lost, "missing").otherwise("kept")
    version = F.when(~known, 1).when(seen & ~same, F.col("current_version") + 1).otherwise(F.col("current_version"))
    return both.select(
        F.coalesce("canonical_url", "u").alias("canonical_url"),
        F.coalesce("t", "title").alias("title"),
        F.coalesce("h", "content_hash").alias("content_hash"),
        version.cast("int").alias("current_version"),
        F.when(seen, "ACTIVE").when(lost, "MISSING").otherwise(F.col("status")).alias("status"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, None).when(lost, now).otherwise(F.col("missing_since")).cast("timestamp").alias("missing_since"),
        change.alias("change"),
    )


def new_versions(merged: DataFrame) -> DataFrame:
    """History rows that a sync adds: one for each url that was added or updated."""
    return merged.filter(F.col("change").isin("added", "updated")).select("canonical_url", F.col("current_version").alias("version"), "title", "content_hash")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], keep_empty: bool = False) -> DataFrame:
    """Rows of both by key. New values win; with keep_empty a null or an empty array changes nothing."""
    renamed = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns)).withColumn("_new", F.lit(True))
    on = [current[k] == renamed[f"_n_{k}"] for k in keys]
    both = current.withColumn("_old", F.lit(True)).join(renamed, on, "full_outer")
    out = []
    for c in current.columns:
        if c not in new.columns:
            out.append(F.col(c))
        elif keep_empty and dict(new.dtypes)[c].startswith("array"):
            out.append(F.when(F.size(f"_n_{c}") > 0, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif keep_empty or c in keys:
            out.append(F.coalesce(f"_n_{c}", c).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def insert_unseen(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key current doesn't have, one for each key, after all rows of current."""
    fresh = new.join(current.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return current.unionByName(fresh)


def replace_groups(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of current whose group new doesn't mention, and all rows of new: a full replacement group by group."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(deleted: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every child table without the rows of the deleted keys."""
    gone = deleted.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in children.items()}
