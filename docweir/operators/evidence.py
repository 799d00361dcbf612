"""Evidence: sets of chunks that prove an answer's points, and audits of the citations in answers."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import citation_numbers

#: States that the cover search holds at once.
STATES = 4096


def best_cover(options: dict[str, list[frozenset]], tokens: dict, limit: int) -> tuple[frozenset, list[str]]:
    """Ids that prove the most requirements, each by one of its bundles; then fewest ids, fewest tokens, smallest ids.

    Requirements are few and bundles small; of one state the choice that covers most is held, and of all at most STATES.
    """
    return _cover(options, tokens, limit)[:2]


def _cover(options: dict[str, list[frozenset]], tokens: dict, limit: int) -> tuple[frozenset, list[str], bool]:
    """best_cover() and whether states were dropped on its way, so that a better one may have been missed."""
    cost = lambda ids: (len(ids), sum(tokens.get(i, 0) for i in ids), sorted((i is not None, i) for i in ids))
    states: dict[frozenset, tuple[str, ...]] = {frozenset(): ()}
    dropped = False
    for name, bundles in options.items():
        minimal = [b for b in bundles if b and not any(o < b for o in bundles if o)]
        after = dict(states)
        for ids, covered in states.items():
            for bundle in minimal:
                merged = ids | bundle
                if len(merged) <= limit and len(covered) + 1 > len(after.get(merged, ())):
                    after[merged] = (*covered, name)
        order = sorted(after.items(), key=lambda x: (-len(x[1]), *cost(x[0])))
        dropped |= len(order) > STATES
        states = dict(order[:STATES])
    ids, covered = min(states.items(), key=lambda x: (-len(x[1]), *cost(x[0])))
    return ids, list(covered), dropped


def evidence_sets(bundles: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, ids, covered, uncovered, dropped) from (query_id, requirement, bundle, id, tokens): ORs of bundles of ANDed ids.

    A bundle becomes one row with its set of ids; those of more than limit ids, which can't be used, go. Of a requirement's
    bundles with the same ids of other requirements only the one of fewest ids, fewest tokens, smallest ids stays, since
    any other in its place makes a cover worse, so a query's sets come together by as many as its requirements can share. An
    id's tokens are the most that any row states. dropped says that the search had more states than STATES, the first of
    which it held.
    """
    of_id = W.partitionBy("query_id", "id")
    named_by = F.struct("requirement")
    known = bundles.select("query_id", "requirement", "bundle", "id", F.max("tokens").over(of_id).alias("tokens"), (F.min(named_by).over(of_id) != F.max(named_by).over(of_id)).alias("shared"))
    sets = known.groupBy("query_id", "requirement", "bundle").agg(F.array_sort(F.collect_set(F.struct("id", "tokens", "shared"))).alias("held")).filter(F.size("held") <= limit)
    total = F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x["tokens"], F.lit(0)))
    cheapest = F.min(F.struct(F.size("held").alias("n"), total.alias("total"), "held", "bundle")).alias("best")
    shared = F.transform(F.filter("held", lambda x: x["shared"]), lambda x: x["id"])
    usable = sets.groupBy("query_id", "requirement", shared.alias("_shared")).agg(cheapest).select("query_id", "requirement", "best.held", "best.bundle")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        options: dict[str, list[frozenset]] = {}
        tokens: dict = {}
        for r in rows.sort_values(["requirement", "bundle"]).itertuples():
            options.setdefault(r.requirement, []).append(frozenset(x["id"] for x in r.held))
            tokens |= {x["id"]: x["tokens"] for x in r.held}
        ids, covered, dropped = _cover(options, tokens, limit)
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "ids": [sorted(ids)], "covered": [covered], "dropped": [dropped]})

    kinds = dict(bundles.dtypes)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    found = usable.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, ids array<{kinds['id']}>, covered array<string>, dropped boolean")
    named = bundles.groupBy("query_id").agg(F.array_sort(F.collect_set("requirement")).alias("names"))  # a query's few requirements
    met = named.join(found, "query_id", "left")
    covered = F.coalesce("covered", none("string"))
    return met.select("query_id", F.coalesce("ids", none(kinds["id"])).alias("ids"), covered.alias("covered"), F.array_except("names", covered).alias("uncovered"), F.coalesce("dropped", F.lit(False)).alias("dropped"))


def audit_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, n_markers, unresolved, unused): markers [n] of answers held against citations (answer_id, number)."""
    marked = answers.select("answer_id", citation_numbers(F.col("text")).alias("found"))
    known = citations.groupBy("answer_id").agg(F.collect_set("number").alias("known"))  # an answer's few citations
    both = marked.join(known, "answer_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))
    return both.select(
        "answer_id",
        F.size("found").alias("n_markers"),
        F.array_sort(F.array_except("found", "known")).alias("unresolved"),
        F.array_sort(F.array_except("known", "found")).alias("unused"),
    )


def supported_units(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, unit, supported): whether every quote bound to a unit stands in the source that it names.

    units has answer_id, unit, number, quote (no row with a null quote is supported), sources answer_id, number, text.
    """
    met = units.join(sources.select("answer_id", "number", F.col("text").alias("source")), ["answer_id", "number"], "left")
    held = F.coalesce(F.contains("source", "quote"), F.lit(False))
    return met.groupBy("answer_id", "unit").agg(F.bool_and(held).alias("supported"))


def surviving(citations: DataFrame, packed: DataFrame) -> DataFrame:
    """Citations from the web, and those whose chunk was packed in the end (query_id, id)."""
    kept = packed.select(F.col("query_id").alias("_q"), F.col("id").alias("_i")).distinct()
    met = citations.join(kept, (F.col("query_id") == F.col("_q")) & (F.col("id") == F.col("_i")), "left")
    return met.filter(F.col("_i").isNotNull() | F.col("source_url").isNotNull()).drop("_q", "_i")


def first_identities(citations: DataFrame, keys: Iterable[str] = ("document_id", "id", "source_url")) -> DataFrame:
    """Of citations with one identity the first by position; nulls are values."""
    least = citations.groupBy(*keys).agg(F.min("position").alias("position"))
    on = F.lit(True)
    renamed = least.toDF(*(f"_{c}" for c in least.columns))
    for c in [*keys, "position"]:
        on = on & citations[c].eqNullSafe(renamed[f"_{c}"])
    return citations.join(renamed, on, "left_semi")
