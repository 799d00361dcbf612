"""A trigram posting table for substring search: which rows can hold a query is looked up, and only those are looked at.

Texts are indexed in lower case with a mark before and behind them, so every character of a text, however short, stands in a
gram. A query of three characters or more asks for its rarest grams; a shorter one for all grams that it stands in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import batched, slices, written

SIZE, EDGE = 3, "\x02"
#: Of a query's grams so many are looked up, the rarest.
RAREST = 4


@dataclass(frozen=True)
class Index:
    """texts: id, text in lower case. postings: gram, id, sorted by gram. counts: gram, n."""

    texts: DataFrame
    postings: DataFrame
    counts: DataFrame


def build(documents: DataFrame, text: Column, key: str = "id") -> Index:
    """Index a text of each document; keys are distinct. Null texts are empty. A text's grams are made distinct where it is read,
    and the postings are dealt by ranges of (gram, key), so a common gram is spread over many files."""
    spark, kind = documents.sparkSession, dict(documents.dtypes)[key]
    texts = written(documents.select(F.col(key).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            who, grams = [], []
            for k, own in enumerate(batch.column("text").to_pylist()):
                own = f"{EDGE}{own}{EDGE}"
                found = {own[i : i + SIZE] for i in range(max(1, len(own) - SIZE + 1))}
                who += [k] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), batch.column("id").take(pa.array(who, pa.int64()))], names=["gram", "id"])

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    postings = batched(texts).mapInArrow(cut, f"gram string, id {kind}").repartitionByRange(parts, "gram", "id").sortWithinPartitions("gram", "id")
    postings = written(postings)
    return Index(texts, postings, written(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))))


def candidates(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, id): rows that may hold queries (query_id, query) that aren't empty; what isn't there surely doesn't."""
    low = queries.select("query_id", F.lower("query").alias("q")).filter("q <> ''").distinct()
    long_ = low.filter(F.char_length("q") >= SIZE)
    places = F.sequence(F.lit(1), F.char_length("q") - SIZE + 1)
    grams = long_.select("query_id", "q", F.explode(F.array_distinct(F.transform(places, lambda k: F.substr("q", k, F.lit(SIZE))))).alias("gram"))
    # a gram that no text has leaves a query without rows, so it stays, as the rarest
    counted = grams.join(index.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy("n", "gram"))
    chosen = written(counted.withColumn("r", rank).filter(F.col("r") <= RAREST).select("query_id", "q", "gram"))
    asked = chosen.groupBy("query_id", "q").agg(F.count(F.lit(1)).alias("asked"))
    met = index.postings.join(chosen, "gram").groupBy("query_id", "q", "id").agg(F.count(F.lit(1)).alias("held"))
    found = met.join(asked, ["query_id", "q"]).filter("held = asked").select("query_id", "id")
    # short queries stand in some of the grams, which are few beside the postings
    parts = index.counts.select("gram", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("gram")), lambda k: F.array(F.substr("gram", k, F.lit(1)), F.substr("gram", k, F.lit(2))))))).alias("q"))
    short = low.filter(F.char_length("q") < SIZE).join(parts, "q").select("query_id", "gram").distinct()
    return found.unionByName(index.postings.join(short, "gram").select("query_id", "id")).distinct()


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, id) of all rows whose text holds a query (query_id, query), whatever the case; an empty query finds none."""
    low = queries.select("query_id", F.lower("query").alias("q")).filter("q <> ''").distinct()
    met = candidates(index, queries).join(low, "query_id").join(index.texts, "id")
    return met.filter(F.contains("text", F.col("q"))).select("query_id", "id").distinct()


def narrowed(index: Index, documents: DataFrame, query: str, key: str = "id") -> DataFrame:
    """The documents that may hold a query, on which a search of fields looks; all of them for a blank one."""
    if not query.strip():
        return documents
    asked = documents.sparkSession.createDataFrame([(0, query.strip())], "query_id int, query string")
    return documents.join(candidates(index, asked).select(F.col("id").alias(key)), key, "left_semi")
