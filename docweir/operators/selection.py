"""Selection of retrieved chunks: gates, blends of ranks, parents, and packing under a token budget."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import top_k


def gate(distance: Column, score: Column, most: float, least: float) -> Column:
    """Near enough, and scored well enough where there is a score; a missing distance counts as 1."""
    return (F.coalesce(distance, F.lit(1.0)) <= most) & (score.isNull() | (score >= least))


def sufficiency(candidates: DataFrame, most: float, least: float, characters: int = 200) -> DataFrame:
    """(query_id, sufficient, reason): enough text, one chunk near enough, one scored well enough (where scores exist)."""
    per = candidates.groupBy("query_id").agg(
        F.sum(F.length("text")).alias("chars"), F.min(F.coalesce("distance", F.lit(1.0))).alias("nearest"), F.max("score").alias("best")
    )
    reason = (
        F.when(F.col("chars") < characters, "context too short").when(F.col("nearest") > most, "too distant").when(F.col("best") < least, "scored too low").otherwise("sufficient")
    )
    return per.select("query_id", (reason == "sufficient").alias("sufficient"), reason.alias("reason"))


def blend_ranks(candidates: DataFrame, limit: int, pool: int, weights: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Of each query's first pool candidates by position the limit best by weighted reciprocal ranks, in their first order.

    candidates has query_id, id, position (order of the reranker) and rrf_score. A null id is left out, a repeated one
    counts once. Ranks are places in the pool by position and by descending rrf_score.
    """
    valid = candidates.filter(F.col("id").isNotNull()).groupBy("query_id", "id").agg(F.min("position").alias("position"), F.min_by("rrf_score", "position").alias("rrf_score"))
    held = top_k(valid, ["query_id"], ["position"], pool, "rerank_rank")
    by_rrf = W.partitionBy("query_id").orderBy(F.desc_nulls_last("rrf_score"), "position")
    scored = held.withColumn("rrf_rank", F.row_number().over(by_rrf))
    scored = scored.withColumn("blend", F.round(weights[0] / F.col("rerank_rank") + weights[1] / F.col("rrf_rank"), 9))
    best = top_k(scored, ["query_id"], [F.desc("blend"), F.asc("rerank_rank"), F.desc("id")], limit, "_n").drop("_n")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rerank_rank")))


def structure_unit(section_id: Column, path: Column, id_: Column) -> Column:
    """A section, else its path, else the chunk itself."""
    joined = F.when(F.size(path) > 0, F.concat(F.lit("path:"), F.array_join(path, "/")))
    return F.coalesce(F.concat(F.lit("section:"), section_id), joined, F.concat(F.lit("chunk:"), id_.cast("string")))


def protected_backfill(candidates: DataFrame, limit: int, protected: int = 6) -> DataFrame:
    """(query_id, id, rank, reason): of candidates (query_id, id, position, rrf_score, unit) the first few by position, then the best
    fused one of each unit that isn't among them yet, then the best of the others, limit in all.

    Taking the best of a new unit again and again is taking each unit's first in the order of the scores, so windows say it.
    An id that stands twice counts by its first position; rows without a unit are of one unit.
    """
    over = lambda *keys: W.partitionBy("query_id", *keys)
    once = candidates.select("query_id", "id", "position", "rrf_score", "unit").withColumn("_n", F.row_number().over(over("id").orderBy("position"))).filter("_n = 1")
    placed = once.withColumn("_p", F.row_number().over(over().orderBy("position", "id"))).withColumn("_kept", F.col("_p") <= min(protected, limit))
    order = [F.desc("rrf_score"), F.asc("position"), F.asc("id")]
    first = F.row_number().over(over("unit", "_kept").orderBy(*order)) == 1
    marked = placed.withColumn("_new", ~F.col("_kept") & first & ~F.max("_kept").over(over("unit")))
    rank = F.row_number().over(over().orderBy(F.desc("_kept"), F.when(F.col("_kept"), F.col("_p")), F.desc("_new"), *order))
    reason = F.when(F.col("_kept"), "protected").when(F.col("_new"), "new section").otherwise("same section")
    return marked.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "id", "rank", reason.alias("reason"))


def parents(children: DataFrame, largest: int = 1500) -> DataFrame:
    """(query_id, context_id, score, n_children, first_position): chunks joined by section, if the section fits, else alone.

    A chunk's score is its reranker score, else its negated distance; a parent's is the best of its chunks.
    """
    fits = F.col("section_id").isNotNull() & (F.col("section_tokens") <= largest)
    context = F.when(fits, F.concat(F.lit("section:"), F.col("section_id"))).otherwise(F.concat(F.lit("child:"), F.col("id").cast("string")))
    score = F.coalesce("score", -F.col("distance"))
    one = children.withColumn("context_id", context).groupBy("query_id", "context_id", "id").agg(F.max(score).alias("s"), F.min("position").alias("position"))
    return one.groupBy("query_id", "context_id").agg(F.max("s").alias("score"), F.count(F.lit(1)).alias("n_children"), F.min("position").alias("first_position"))


def pack(blocks: Iterable[tuple], budget: int, most: int, per_document: int, backfill: bool = False) -> list[tuple[str, str]]:
    """(context_id, reason) of one query's blocks (context_id, document_id, tokens) in their order.

    A block that is a repetition, over the cap, over its document's cap or over the budget is passed over, and the next is
    tried; with backfill the blocks that only their document's cap kept out are tried once more at the end.
    """
    used, count, seen, per, out, deferred = 0, 0, set(), {}, [], []
    for context, document, tokens in blocks:
        if context in seen:
            reason = "duplicate"
        elif count >= most:
            reason = "over the cap"
        elif per.get(document, 0) >= per_document:
            reason = "over the document's cap"
            deferred.append((context, document, tokens))
        elif used + tokens > budget:
            reason = "over the budget"
        else:
            reason, used, count = "packed", used + tokens, count + 1
            per[document] = per.get(document, 0) + 1
        seen.add(context)
        out.append((context, reason))
    for context, _, tokens in deferred if backfill else []:
        if count < most and used + tokens <= budget:
            out[[c for c, _ in out].index(context)] = (context, "packed late")
            used, count = used + tokens, count + 1
    return out


def pack_contexts(parents_: DataFrame, budget: int = 6000, most: int = 8, per_document: int = 5, backfill: bool = False) -> DataFrame:
    """(query_id, context_id, place, reason): each query's parents by descending score under pack()'s rules.

    Packing depends on what was packed before, so each query's candidates, a bounded list, go through one Python call.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "context_id"], ascending=[False, True], kind="stable")
        found = pack(rows[["context_id", "document_id", "tokens"]].itertuples(index=False, name=None), budget, most, per_document, backfill)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "context_id": [c for c, _ in found], "place": range(1, len(found) + 1), "reason": [r for _, r in found]})

    kind = dict(parents_.dtypes)["query_id"]
    return parents_.groupBy("query_id").applyInPandas(one, f"query_id {kind}, context_id string, place int, reason string")


def number_citations(citations: DataFrame) -> DataFrame:
    """Add number: 1, 2, ... to each answer's distinct sources in the order of their first mention (answer_id, position, source)."""
    first = citations.groupBy("answer_id", "source").agg(F.min("position").alias("first"))
    numbered = first.withColumn("number", F.row_number().over(W.partitionBy("answer_id").orderBy("first", "source"))).drop("first")
    return citations.join(numbered, ["answer_id", "source"])


def allocate_aspects(candidates: DataFrame, aspects: DataFrame, limit: int, most: float, least: float, depth: int = 2) -> DataFrame:
    """(query_id, id, rank, reserved): the first eligible chunks of each aspect, then the others in their order, limit in all.

    candidates has query_id, id, position, distance, score; aspects has query_id, aspect, id, position. Only candidates
    within the gate are eligible. First every aspect's best, then every aspect's second, up to depth; a chunk that two
    aspects reserve counts once.
    """
    fit = candidates.filter(gate(F.col("distance"), F.col("score"), most, least))
    own = aspects.join(fit.select("query_id", "id"), ["query_id", "id"], "left_semi")
    held = top_k(own, ["query_id", "aspect"], ["position", "id"], depth, "round")
    first = held.groupBy("query_id", "id").agg(F.min(F.struct("round", "aspect")).alias("turn"))
    both = fit.join(first, ["query_id", "id"], "left")
    order = [F.col("turn").isNull(), F.col("turn.round"), F.col("turn.aspect"), F.col("position"), F.col("id")]
    return top_k(both, ["query_id"], order, limit).select("query_id", "id", "rank", F.col("turn").isNotNull().alias("reserved"))


def merge_parents(calls: DataFrame) -> DataFrame:
    """(query_id, context_id, score, children): parents of several calls (call, query_id, context_id, score, children) joined.

    The best score counts; children keep the order in which the calls brought them, each once.
    """
    each = calls.select("query_id", "context_id", "score", "call", F.posexplode("children").alias("at", "child"))
    once = each.groupBy("query_id", "context_id", "child").agg(F.min(F.struct("call", "at")).alias("first"), F.max("score").alias("s"))
    kids = F.transform(F.array_sort(F.collect_list(F.struct("first", "child"))), lambda x: x["child"])  # a context's few chunks
    return once.groupBy("query_id", "context_id").agg(F.max("s").alias("score"), kids.alias("children"))


def uncovered(facets: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, facet) of which no bundle was packed whole: facets has query_id, facet, bundles, packed has query_id, id."""
    held = packed.groupBy("query_id").agg(F.collect_set("id").alias("ids"))  # a context's few chunks
    met = facets.join(held, "query_id", "left")
    whole = F.exists("bundles", lambda b: (F.size(b) > 0) & (F.size(F.array_except(b, F.coalesce("ids", F.array()))) == 0))
    return met.filter(~F.coalesce(whole, F.lit(False))).select("query_id", "facet")
