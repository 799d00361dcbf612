"""Lexical and dense search, and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import query_words
from . import lexical, metric

#: Words that a lexical query leaves out; must, should, may and not stay, since they carry a rule's force. Fixed values.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was were what which who with".split()


def top_k(df: DataFrame, within: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; each task keeps k of its own before the shuffle."""
    number = F.row_number().over(W.partitionBy(*within).orderBy(*order))
    return df.withColumn(rank, number).filter(F.col(rank) <= k)


def query_terms(queries: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(query_id, term): the distinct terms of each query's text that aren't stop words."""
    return lexical.asked_terms(queries, lexical.plain, stop_words)


def lexical_terms(queries: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(query_id, term): the distinct words of letters and digits of any script that aren't stop words."""
    kept = F.array_except(query_words(F.col("text")), F.array(*map(F.lit, stop_words)).cast("array<string>"))
    return queries.select("query_id", F.explode(kept).alias("term"))


def bm25(docs: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) for rows of docs (id, text) that hold a query's terms (query_id, term).

    Statistics are those of all docs. Texts are split once, into compatible, lower-case words; see lexical.term_counts(),
    whose result overlap() can share.
    """
    return lexical.bm25(lexical.term_counts(docs, terms), terms, k1, b)


def overlap(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, overlap): how many of a query's terms (query_id, term) each row of docs (id, text) holds."""
    return lexical.overlap(lexical.term_counts(docs, terms), terms)


def fuse(rankings: dict[str, DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank): rrf_score, n_sources, and each source's rank.

    Of an id that one ranking holds twice the better rank counts.
    """
    firsts = [
        df.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).withColumn("source", F.lit(name)) for name, df in rankings.items()
    ]
    both = reduce(DataFrame.unionByName, firsts)
    own = [F.max(F.when(F.col("source") == name, F.col("rank"))).alias(f"{name}_rank") for name in rankings]
    score = F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("rrf_score")
    return both.groupBy("query_id", "id").agg(score, F.count(F.lit(1)).alias("n_sources"), *own)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of vectors (id, embedding) by cosine for each query (query_id, embedding).

    Exact, by the metric index: see metric.nearest().
    """
    return metric.nearest(vectors, queries, k, exclude_self)


def nearest_of(vectors: DataFrame, few: DataFrame) -> DataFrame:
    """(query_id, id, distance): for each of vectors (query_id, embedding) the nearest of few (id, embedding)."""
    return metric.nearest(few, vectors, 1).drop("rank")


def hybrid(docs: DataFrame, vectors: DataFrame, terms: DataFrame, queries: DataFrame, limit: int, constant: int = 60) -> DataFrame:
    """(query_id, id, rrf_score, n_sources, dense_rank, lexical_rank, distance): both branches' first limit, fused by reciprocal ranks.

    docs is the scope (id, text), whose rows the vectors (id, embedding) belong to; terms (query_id, term) and queries
    (query_id, embedding) ask. distance is that to the query's own vector, also of candidates that words alone found; one
    without a vector has none.
    """
    from ..functions.vectors import distance

    own = vectors.join(docs.select("id"), "id", "left_semi")
    dense = batch_knn(own, queries, limit).select("query_id", "id", "rank")
    by_words = lexical.ranked(docs, terms, limit, {"bm25": lexical.bm25_rate})["bm25"].select("query_id", "id", "rank")
    both = fuse({"dense": dense, "lexical": by_words}, constant)
    asked, held = queries.select("query_id", F.col("embedding").alias("_q")), own.select("id", F.col("embedding").alias("_v"))
    met = both.join(asked, "query_id", "left").join(held, "id", "left")
    return met.select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "n_sources", "dense_rank", "lexical_rank", F.round(distance(F.col("_q"), F.col("_v")), 6).alias("distance"))


def rerank(candidates: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): candidates (query_id, id, position, text) with text, best score first, ties in their order.

    scores (query_id, id, score) come from a model; a candidate that it didn't score has 0.
    """
    held = candidates.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("query_id", "id", "position")
    scored = held.join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("position")], limit).select("query_id", "id", "score", "rank")


def exact_labels(values: DataFrame, leaves: DataFrame, other: str = "Other") -> DataFrame:
    """(owner, labels): the leaves (label) that an owner's values (owner, position, value) name, whatever the case, each once, in
    order; other for an owner without any."""
    by_name = leaves.groupBy(F.lower("label").alias("_name")).agg(F.max("label").alias("label"))
    met = values.join(by_name, F.lower(F.trim("value")) == F.col("_name"), "left")
    first = met.groupBy("owner", "label").agg(F.min("position").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("at", "label")))), lambda x: x["label"])
    return first.groupBy("owner").agg(F.when(F.count("label") > 0, listed).otherwise(F.array(F.lit(other))).alias("labels"))


def nearest_labels(values: DataFrame, leaves: DataFrame, least: float = 0.5, most: int = 6) -> DataFrame:
    """(owner, labels): each value's (owner, position, value, embedding) nearest leaf (label, embedding) if it is near enough, each
    once, most at most; exact_labels() for an owner without any."""
    asked = values.select(F.struct("owner", "position").alias("query_id"), "embedding").filter("embedding is not null")
    keyed = asked.withColumn("query_id", F.to_json("query_id"))
    near = nearest_of(keyed, leaves.select(F.col("label").alias("id"), "embedding")).filter(F.col("distance") <= 1 - least)
    back = values.withColumn("_k", F.to_json(F.struct("owner", "position"))).join(near, F.col("_k") == F.col("query_id"))
    first = back.groupBy("owner", "id").agg(F.min("position").alias("at"))
    found = first.groupBy("owner").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]), 1, most).alias("near"))
    exact = exact_labels(values, leaves)
    return exact.join(found, "owner", "left").select("owner", F.coalesce("near", "labels").alias("labels"))
