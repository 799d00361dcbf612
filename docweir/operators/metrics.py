"""Retrieval quality and corpus audits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .tables import batched, slices


def group_scores(rankings: DataFrame, groups: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row for each query: hit, group coverage and completeness at each k, and the reciprocal rank within 10.

    rankings has query_id, id, rank; groups has query_id, group_id, id, any one of which proves the group. Queries whose
    groups were not ranked at all have zeros.
    """
    best = groups.join(rankings, ["query_id", "id"], "left").groupBy("query_id", "group_id").agg(F.min("rank").alias("rank"))
    at = []
    for k in ks:
        held = F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
        at += [F.max(held).alias(f"hit_{k}"), F.avg(held).alias(f"coverage_{k}"), F.min(held).alias(f"complete_{k}")]
    first = F.min("rank")
    return best.groupBy("query_id").agg(*at, F.when(first <= 10, 1 / first).otherwise(0.0).alias("rr_10"))


def label_scores(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, first_rank, hit_5, hit_20, rr_10) where any of gold's (query_id, id) answers a query."""
    first = gold.join(rankings, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    hit = lambda k: F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}")
    return first.select("query_id", "first_rank", hit(5), hit(20), F.when(F.col("first_rank") <= 10, 1 / F.col("first_rank")).otherwise(0.0).alias("rr_10"))


#: Bytes of quotes that one automaton holds; more of them take further passes over the texts.
QUOTE_BYTES = 2_000_000


def _quote_blocks(quotes: DataFrame) -> Iterator[list]:
    held, size = [], 0
    for row in quotes.toLocalIterator():
        held.append(row)
        size += len(row.quote) + 50
        if size >= QUOTE_BYTES:
            yield held
            held, size = [], 0
    yield held


def resolve_anchors(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(quote_id, id): the chunks (id, document, page_start, page_end, text) of the quoted document whose pages meet the quote's
    and whose text holds it, whatever its length; quotes has quote_id, document, page_start, page_end, quote.

    An Aho-Corasick automaton over all quotes of a block finds them in one walk through each text, and document and pages
    decide which of them count, so nothing is joined and no text is shuffled. A null or empty quote stands nowhere; a quote
    with a null document or page too; repeated quotes and chunks count once each row.
    """
    spark, schema = chunks.sparkSession, T.StructType([quotes.schema["quote_id"], chunks.schema["id"]])
    kind = to_arrow_type(schema["quote_id"].dataType)
    wanted = quotes.select("quote_id", "document", "page_start", "page_end", "quote").filter("quote <> '' and document is not null and page_start is not null and page_end is not null")
    out = None
    for block in _quote_blocks(wanted):
        sent = spark.sparkContext.broadcast([(r.quote_id, r.document, r.page_start, r.page_end, r.quote) for r in block])

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, of = ahocorasick.Automaton(), {}
            for quote_id, document, first, last, quote in sent.value:
                of.setdefault(quote, []).append((quote_id, document, first, last))
            for quote in of:
                automaton.add_word(quote, quote)
            if of:
                automaton.make_automaton()
            for batch in slices(batches):
                who, found = [], []
                columns = [batch.column(c).to_pylist() for c in ("document", "page_start", "page_end", "text")]
                for k, (document, first, last, text) in enumerate(zip(*columns, strict=True)):
                    if not of or not text or first is None or last is None:
                        continue
                    for quote in {q for _, q in automaton.iter(text)}:
                        own = [q for q, d, a, b in of[quote] if d == document and first <= b and last >= a]
                        who += [k] * len(own)
                        found += own
                yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column("id").take(pa.array(who, pa.int64()))], names=["quote_id", "id"])

        met = batched(chunks.select("id", "document", "page_start", "page_end", "text")).mapInArrow(find, schema)
        out = met if out is None else out.unionByName(met)
    return out


def minimum_cover(masks: Iterable[int], full: int) -> int:
    """The fewest masks whose bits make up full; -1 if all of them don't.

    Branch and bound over the bit that the fewest masks have: masks inside others go, a bit with one mask takes it, and a
    branch ends where the largest masks left can't beat the best cover known. Bits may be any number.
    """
    masks = {m & full for m in masks} - {0}
    reach = 0
    for m in masks:
        reach |= m
    if reach != full:
        return -1
    best = len(masks) + 1 if full else 0

    def search(left: int, masks: set[int], taken: int) -> None:
        nonlocal best
        while left:
            masks = {m & left for m in masks} - {0}
            ordered = sorted(masks, key=lambda m: -m.bit_count())
            kept: list[int] = []
            for m in ordered:
                if not any(m | k == k for k in kept):
                    kept.append(m)
            if taken + -(-left.bit_count() // kept[0].bit_count()) >= best:
                return
            holders, rest = None, left
            while rest:  # the bit that the fewest masks have
                bit = rest & -rest
                rest ^= bit
                own = [m for m in kept if m & bit]
                if holders is None or len(own) < len(holders):
                    holders = own
                    if len(own) == 1:
                        break
            if len(holders) > 1:
                for m in holders:
                    search(left & ~m, set(kept), taken + 1)
                return
            left, masks, taken = left & ~holders[0], set(kept), taken + 1
        best = min(best, taken)

    search(full, masks, 0)
    return best


def minimum_covers(groups: DataFrame) -> DataFrame:
    """(query_id, n_cover): the fewest ids that meet every group of each query's (group_id, id) rows, however many groups it has.

    What an id meets becomes a list of bit numbers in a grouped set, so a query is as many lists as differ, however many ids it has.
    """
    bit = F.dense_rank().over(W.partitionBy("query_id").orderBy("group_id")) - 1
    bits = groups.select("query_id", "group_id").distinct().withColumn("bit", bit)
    full = bits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = groups.join(bits, ["query_id", "group_id"]).groupBy("query_id", "id").agg(F.array_sort(F.collect_set("bit")).alias("mask"))
    masks = met.groupBy("query_id").agg(F.collect_set("mask").alias("masks")).join(full, "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            covers = [minimum_cover((sum(1 << int(b) for b in m) for m in own), (1 << int(n)) - 1) for own, n in zip(batch["masks"], batch["n"], strict=True)]
            yield pd.DataFrame({"query_id": batch["query_id"], "n_cover": covers})

    return batched(masks).mapInPandas(run, f"query_id {dict(groups.dtypes)['query_id']}, n_cover int")


def calibrate(cases: DataFrame) -> DataFrame:
    """One row: how far scores of sufficient and insufficient cases lie apart, and the threshold between them.

    The threshold is the middle of the gap; where there is none, overlap is true and it is the middle of the overlap.
    """
    yes, no = F.when(F.col("sufficient"), F.col("score")), F.when(~F.col("sufficient"), F.col("score"))
    s = cases.agg(F.min(yes).alias("least_yes"), F.avg(yes).alias("mean_yes"), F.max(no).alias("most_no"), F.avg(no).alias("mean_no"))
    return s.select("*", (F.col("least_yes") <= F.col("most_no")).alias("overlap"), ((F.col("least_yes") + F.col("most_no")) / 2).alias("threshold"))


def margins(scores: DataFrame) -> DataFrame:
    """(query_id, top1, margin): whether the best scored candidate is relevant, and how far the best relevant one leads."""
    good = F.max(F.when(F.col("relevant"), F.col("score")))
    bad = F.max(F.when(~F.col("relevant"), F.col("score")))
    return scores.groupBy("query_id").agg((good > bad).cast("int").alias("top1"), (good - bad).alias("margin"))


def mismatches(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem) of keys that only one of two tables has."""
    a, b = expected.select(F.col(key).alias("a")).distinct(), found.select(F.col(key).alias("b")).distinct()
    both = a.join(b, F.col("a").eqNullSafe(F.col("b")), "full_outer").filter("a is null or b is null")
    return both.select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "missing").otherwise("unexpected").alias("problem"))


def split_leaks(cases: DataFrame) -> DataFrame:
    """(leakage_group, n_splits) of groups whose cases stand in more than one split."""
    return cases.groupBy("leakage_group").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def first_in_window(df: DataFrame, within: str, when, order: str) -> DataFrame:
    """Add from_last: whether a row stands at or after the last row of its group for which when holds."""
    last = F.max(F.when(when, F.col(order))).over(W.partitionBy(within))
    return df.withColumn("from_last", F.col(order) >= F.coalesce(last, F.lit(-1)))


def unresolved_anchors(quotes: DataFrame, found: DataFrame) -> DataFrame:
    """quote_id of quotes that no chunk holds: a set with any isn't fit for scoring."""
    return quotes.select("quote_id").join(found.select("quote_id").distinct(), "quote_id", "left_anti")


def replay_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, state) of two runs' cases (query_id, complete): recovered, regressed, kept or open; one run's alone are new or gone."""
    a, b = before.select("query_id", F.col("complete").alias("a")), after.select("query_id", F.col("complete").alias("b"))
    state = (
        F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(~F.col("a") & F.col("b"), "recovered")
        .when(F.col("a") & ~F.col("b"), "regressed").when(F.col("b"), "kept").otherwise("open")
    )
    return a.join(b, "query_id", "full").select("query_id", state.alias("state"))
