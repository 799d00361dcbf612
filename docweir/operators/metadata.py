"""Nested metadata as variants: parsed once, looked into by path, searched at any depth, and the projection of document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import string_list
from .tables import written


def parsed(df: DataFrame, column: str, out: str = "metadata") -> DataFrame:
    """df with a JSON text as a variant, null where it isn't JSON."""
    return df.withColumn(out, F.try_parse_json(column))


def at(variant: str | Column, path: str, kind: str) -> Column:
    """The value at a path as a type, null where there is none or it is of another kind."""
    return F.try_variant_get(variant, path, kind)


def leaves(df: DataFrame, key: str, variant: str) -> DataFrame:
    """(key, path, name, value): every key and every plain value of a variant, at any depth, as text; list items have no name.

    Containers are opened level by level, each level written once, so a table is opened as often as its deepest value is
    deep and no level is computed again. Plain values at the top have the path $.
    """
    spark = df.sparkSession
    kind = lambda v: F.schema_of_variant(v)
    nested = lambda v: F.startswith(kind(v), F.lit("OBJECT")) | F.startswith(kind(v), F.lit("ARRAY"))
    held = written(df.select(F.col(key).alias("_k"), F.col(variant).alias("_v"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name")).filter("_v is not null"))
    out = None
    while True:
        plain = held.select("_k", "path", "name", F.when(~nested(F.col("_v")), F.col("_v").cast("string")).alias("value")).filter("name is not null or value is not null")
        out = plain if out is None else out.unionByName(plain)
        open_ = held.filter(nested(F.col("_v")))
        inside = open_.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        held = written(inside.select("_k", F.col("value").alias("_v"), F.concat("path", step).alias("path"), F.col("key").alias("name")))
        if held.isEmpty():
            return out.select(F.col("_k").alias(key), "path", "name", "value")


def containing(df: DataFrame, key: str, variant: str, query: str) -> DataFrame:
    """The keys of rows whose metadata has the query in any key or plain value, whatever the case."""
    found = leaves(df, key, variant)
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return found.filter(holds(F.col("name")) | holds(F.col("value"))).select(key).distinct()


def iso(value: Column, kind: str) -> Column:
    """A date or time as ISO text; times in UTC, with microseconds where there are any."""
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    part = F.when(F.date_format(value, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(value, "SSSSSS"))).otherwise("")
    zone = "" if kind == "timestamp_ntz" else "+00:00"
    utc = value if kind == "timestamp_ntz" else F.to_utc_timestamp(value, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit(zone))


#: Fields as they are, those that stand under two names, and those with a value where a row has none. Fixed values.
PLAIN = "stored_filename status error_message title summary source_type source_organisation country_region language year source_url imported_via".split()
TWICE = {"name": "original_filename", "original_filename": "original_filename", "relative_path": "file_path", "file_path": "file_path", "size": "file_size", "file_size": "file_size"}
DEFAULTS = {"approved": True, "access_level": "public", "page_count": 0, "chunk_count": 0}


def projection(rows: DataFrame) -> DataFrame:
    """Document rows as their metadata is shown: ids as text, names that stand twice, times as ISO text and as seconds, lists of
    keywords and policy areas, and defaults. approved and access_level have a default only where rows have no such column;
    any column but id may be missing."""
    kinds = dict(rows.dtypes)
    own = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    time = lambda c: iso(F.col(c), kinds[c]) if c in kinds else F.lit(None).cast("string")
    listed = lambda c: F.col(c) if kinds.get(c, "").startswith("array") else string_list(own(c))
    none = F.array().cast("array<string>")
    out = {"id": F.col("id").cast("string")} | {c: own(of) for c, of in TWICE.items()}
    out["modified_at"] = F.unix_micros(F.col("uploaded_at").cast("timestamp")) / 1e6 if "uploaded_at" in kinds else F.lit(None).cast("double")
    out |= {c: own(c) for c in PLAIN} | {c: time(c) for c in ("uploaded_at", "processed_at", "publication_date")}
    out |= {c: F.coalesce(listed(c), none) for c in ("keywords", "policy_areas")}
    out |= {c: F.col(c) if c in kinds and c in ("approved", "access_level") else F.coalesce(F.col(c), F.lit(v)) if c in kinds else F.lit(v) for c, v in DEFAULTS.items()}
    out["imported_by"] = own("imported_by").cast("string")
    return rows.select(*(c.alias(name) for name, c in out.items()))
