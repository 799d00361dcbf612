"""Exact and near duplicates, table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """(key, n, first_id) of the groups that have more than one row."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("first_id")).filter("n > 1")


def keep_best(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """All rows with keep: whether a row is the first of its group in the order given.

    The best row of each group is found as a minimum, which tasks combine before the shuffle, so a group with most of the
    rows costs one row a task; the rows then meet it in a join that splits such a group.
    """
    keyed = df.withColumn("_key", key)
    best = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_best")).withColumnRenamed("_key", "_k")
    met = keyed.join(best, keyed["_key"].eqNullSafe(best["_k"]))
    return met.withColumn("keep", F.struct(*order) == F.col("_best")).drop("_key", "_k", "_best")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row with the number of rows and an order-free sum of row digests: equal tables have equal rows."""
    rows = df.select(F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})), 1, 12), 16, 10).cast("decimal(38,0)").alias("h"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("h").alias("digest"))


def near_pairs(vectors: DataFrame, queries: DataFrame, k: int = 5, limit: float = 0.05) -> DataFrame:
    """Pairs (query_id, id, distance) among each query's k nearest others that are within the distance limit."""
    from .search import batch_knn

    found = batch_knn(vectors, queries, k, exclude_self=True)
    return found.filter(F.col("distance") <= limit)


def import_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    """Of each new row (id, url, hash) the known row that it repeats: by url, else by hash; matched_by says which."""
    w = lambda c: known.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.min("id").alias(f"by_{c}"))
    met = new.join(w("url"), new["url"] == F.col("_url"), "left").join(w("hash"), new["hash"] == F.col("_hash"), "left")
    by = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_hash").isNotNull(), "hash").otherwise("none")
    return met.select(*(new[c] for c in new.columns), F.coalesce("by_url", "by_hash").alias("existing_id"), by.alias("matched_by"))


def import_chain(new: DataFrame, known: DataFrame, vectors: DataFrame, limit: float = 0.05) -> DataFrame:
    """import_matches() and, for rows that neither url nor hash knows, the nearest known row within limit by vector.

    vectors has id and embedding of new and known rows alike.
    """
    from .search import batch_knn

    first = import_matches(new, known)
    rest = first.filter("matched_by = 'none'").select(F.col("id").alias("query_id"))
    asked = vectors.join(rest, vectors["id"] == rest["query_id"]).select("query_id", "embedding")
    held = vectors.join(known.select("id").distinct(), "id", "left_semi")
    near = batch_knn(held, asked, 1, exclude_self=True).filter(F.col("distance") <= limit).select(F.col("query_id").alias("_q"), F.col("id").alias("_near"))
    met = first.join(near, first["id"] == near["_q"], "left")
    by = F.when((F.col("matched_by") == "none") & F.col("_near").isNotNull(), "vector").otherwise(F.col("matched_by"))
    return met.select(*(first[c] for c in new.columns), F.coalesce("existing_id", "_near").alias("existing_id"), by.alias("matched_by"))
