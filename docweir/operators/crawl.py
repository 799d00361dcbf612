"""Crawls over pages that are at hand, and layout hints of printed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import reachable

__all__ = ["best_per_owner", "complete", "layout_hints", "reachable"]


def complete(errors: Column, expected: Column, discovered: Column, fetched: Column, capped: Column, exhausted: Column) -> Column:
    """A crawl without errors that met the expected number twice, or where none was expected ran out of pages uncapped."""
    met = F.when(expected.isNotNull(), (discovered >= expected) & (fetched >= expected)).otherwise(~capped & exhausted)
    return (errors == 0) & met


def best_per_owner(scored: DataFrame) -> DataFrame:
    """(owner, id, distance): of each owner's chunks the nearest; the first by position of equals."""
    best = F.min_by(F.struct("id", "distance"), F.struct("distance", "position")).alias("b")
    return scored.groupBy("owner").agg(best).select("owner", "b.id", "b.distance")


def layout_hints(spans: DataFrame) -> DataFrame:
    """Hints of each line from its spans (doc, page, line, text, size, bold, y, page_height).

    The body size is the one with the most characters in the document. A line is bold if 85 % of its characters are, large
    from 1.12 of the body size on, a footnote if it is smaller than 0.87 of it in the lower third, and a margin line in the
    top 3.5 % or where its text (digits alike) stands in the outer 8 % of three pages or more. heading_level counts the
    larger sizes that the document has.
    """
    chars = F.length("text")
    sizes = spans.groupBy("doc", "size").agg(F.sum(chars).alias("n"))
    body = sizes.groupBy("doc").agg(F.max_by("size", F.struct("n", "size")).alias("body"))
    order = W.partitionBy("doc").orderBy(F.desc("size"))
    levels = sizes.withColumn("heading_level", F.least(F.lit(6), F.row_number().over(order))).select("doc", F.col("size").alias("font_size"), "heading_level")
    lines = spans.groupBy("doc", "page", "line").agg(
        (F.sum(F.when(F.col("bold"), chars).otherwise(0)) >= 0.85 * F.sum(chars)).alias("bold"), F.max("size").alias("font_size"),
        F.min(F.col("y") / F.col("page_height")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    outer = (F.col("at") < 0.08) | (F.col("at") > 0.92)
    key = F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#")
    again = lines.filter(outer).groupBy("doc", key.alias("key")).agg(F.count_distinct("page").alias("pages")).filter("pages >= 3").select(F.col("doc").alias("_d"), F.col("key").alias("_k"), F.lit(True).alias("again"))
    marked = lines.join(body, "doc").join(levels, ["doc", "font_size"]).withColumn("key", key)
    marked = marked.join(again, (F.col("doc") == F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return marked.select(
        "doc", "page", "line", "text", "bold", "font_size", (F.col("font_size") >= 1.12 * F.col("body")).alias("large"),
        ((F.col("font_size") < 0.87 * F.col("body")) & (F.col("at") > 0.65)).alias("footnote"),
        ((F.col("at") < 0.035) | (outer & F.coalesce("again", F.lit(False)))).alias("margin"), "heading_level",
    )
