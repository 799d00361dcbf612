"""What a model is given of the evidence: packed blocks with numbered citations, flat contexts, and whether an answer may be written.

Packing a question depends on what was packed before, so each question's bounded candidates go through one Python call;
gates, parents, coverage and routing around it are DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .selection import gate, uncovered
from .tables import written

#: The texts that the blocks of a context are made of.
BREAK = "\n\n---\n\n"
NO_EXPANSION = "(Supporting evidence below; no additional expansion.)"
SHOWN_BELOW = "\n[Supporting Child text shown below.]\n"
REASONS = {
    "partial": "Coverage is not certified. Answer only supported parts and explicitly identify gaps in the provided context; do not infer absence from the entire corpus.",
    "no_context": "No usable document evidence fits the available context budget.",
}


def context_budget(overhead: Column | int = 0, most: int = 6000, window: int = 32768, reserved: int = 2048, safety: int = 512) -> Column:
    """Tokens that a context may have beside the prompt's overhead."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.lit(window - reserved - safety) - overhead))


def candidate_limit(limit: Column | int, child_k: int) -> Column:
    """How many candidates a search takes for so many results."""
    return F.greatest(F.lit(3) * limit, F.lit(20), F.lit(child_k))


@dataclass
class Block:
    """A parent with the chunks that support it: (id, page_start, page_end, text) each."""

    context: str
    document: str
    file: str
    title: str | None
    text: str
    score: float
    chunks: list[tuple[str, int | None, int | None, str]] = field(default_factory=list)

    def render(self, numbers: dict[str, int]) -> str:
        proof = "\n\n".join(f"[{numbers[i]}] Child evidence, pages {a}–{b}:\n{t}" for i, a, b, t in self.chunks)
        head = f"Document: {self.file}\nSection: {self.title or ''}\nGeneration context (not independently retrieved evidence):\n"
        return f"{head}{self.text or NO_EXPANSION}\n\nCite only the supporting child evidence below:\n{proof}"

    def without_chunks(self) -> str:
        """The parent's text where the chunks, which are shown below it, stand as a mark."""
        text = self.text
        for *_, t in self.chunks:
            text = text.replace(t, SHOWN_BELOW)
        return text


def numbered(ids: list[str], known: dict[str, int]) -> dict[str, int]:
    """Known numbers and, for the other ids in their order, the next ones."""
    out, last = dict(known), max(known.values(), default=0)
    for i in ids:
        if i not in out:
            last += 1
            out[i] = last
    return out


def build_context(blocks: list[Block], budget: int, count: Callable[[str], int], most: int = 8, per_document: int = 5, backfill: bool = False, known: dict[str, int] | None = None) -> tuple[str, list[tuple[str, str]], dict[str, int], set[str]]:
    """The context of blocks in their order, (context, reason) of each, the numbers of its chunks, and the expanded contexts.

    First the evidence alone of as many blocks as the budget and the caps allow, then their own texts where these still fit.
    """
    held: list[Block] = []
    numbers = dict(known or {})

    def whole(parts: list[Block], own: dict[str, int]) -> str:
        return BREAK.join(b.render(own) for b in parts)

    reasons: list[tuple[str, str]] = []
    seen: set[str] = set()
    per: dict[str, int] = {}

    def take(b: Block, reason: str) -> str:
        nonlocal numbers
        own = numbered([c[0] for c in b.chunks], numbers)
        if count(whole([*held, replace(b, text="")], own)) > budget:
            return "over the budget"
        held.append(replace(b, text=""))
        numbers = own
        seen.add(b.context)
        per[b.document] = per.get(b.document, 0) + 1
        return reason

    late: list[Block] = []
    for b in blocks:
        if b.context in seen:
            why = "duplicate"
        elif len(held) >= most:
            why = "over the cap"
        elif per.get(b.document, 0) >= per_document:
            why = "over the document's cap"
            late.append(b)
        else:
            why = take(b, "packed")
        reasons.append((b.context, why))
    for b in late if backfill else []:
        why = "duplicate" if b.context in seen else "over the cap" if len(held) >= most else take(b, "packed late")
        reasons.append((b.context, why))
    of = {b.context: b for b in reversed(blocks)}
    expanded: set[str] = set()
    for k, b in enumerate(held):
        wider = replace(b, text=of[b.context].without_chunks())
        if count(whole([*held[:k], wider, *held[k + 1 :]], numbers)) <= budget:
            held[k] = wider
            if wider.text.replace(SHOWN_BELOW, "").strip():
                expanded.add(b.context)
    return whole(held, numbers), reasons, numbers, expanded


def pack_evidence(children: DataFrame, parents: DataFrame, budget: int = 6000, count: Callable[[str], int] = lambda t: len(t.encode()), most: int = 8, per_document: int = 5, backfill: bool = False, by_score: bool = True) -> DataFrame:
    """(query_id, context, context_ids, chunk_ids, numbers, expanded, truncated) of each question.

    parents has query_id, context_id, document_id, file, section_title, text, score and position; children query_id,
    context_id, id, page_start, page_end, text and position. Parents go by descending score, else by position; equal ones
    by context_id. Both lists of a question are bounded by its candidates.
    """
    kids = children.groupBy("query_id", "context_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "page_start", "page_end", "text"))).alias("kids"))
    met = parents.join(kids, ["query_id", "context_id"], "left")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "context_id"] if by_score else ["position", "context_id"], ascending=[not by_score, True], kind="stable")
        whole = lambda x: None if pd.isna(x) else int(x)
        blocks = [
            Block(r.context_id, r.document_id, r.file, r.section_title, r.text or "", r.score, [(str(k["id"]), whole(k["page_start"]), whole(k["page_end"]), k["text"]) for k in (r.kids if r.kids is not None else [])])
            for r in rows.itertuples()
        ]
        context, reasons, numbers, expanded = build_context(blocks, budget, count, most, per_document, backfill)
        packed = [c for c, why in reasons if why.startswith("packed")]
        of = {b.context: b for b in reversed(blocks)}
        ids = [i for c in packed for i, *_ in of[c].chunks]
        out = (rows["query_id"].iloc[0], context, packed, ids, [numbers[i] for i in ids], sorted(expanded), len(packed) < len(blocks))
        return pd.DataFrame([out], columns=["query_id", "context", "context_ids", "chunk_ids", "numbers", "expanded", "truncated"])

    kind = dict(parents.dtypes)["query_id"]
    schema = f"query_id {kind}, context string, context_ids array<string>, chunk_ids array<string>, numbers array<int>, expanded array<string>, truncated boolean"
    return met.groupBy("query_id").applyInPandas(one, schema)


def strict_context(candidates: DataFrame, packed: DataFrame, facets: DataFrame, most: float, least: float, stopped: DataFrame | None = None) -> DataFrame:
    """(query_id, allowed, coverage_status): generation only where packed evidence covers every facet.

    candidates has query_id, distance and score, packed is pack_evidence() of those within the gate, facets has query_id,
    facet, bundles. stopped lists the query_ids whose retrieval ended by an error or by time, which certify nothing.
    """
    fit = candidates.filter(gate(F.col("distance"), F.col("score"), most, least)).select("query_id").distinct().withColumn("fit", F.lit(True))
    held = packed.select("query_id", (F.col("context") != "").alias("has"), "chunk_ids")
    ids = held.select("query_id", F.explode("chunk_ids").alias("id"))
    gaps = uncovered(facets, ids).groupBy("query_id").agg(F.count(F.lit(1)).alias("gaps"))
    out = candidates.select("query_id").distinct().join(fit, "query_id", "left").join(held, "query_id", "left").join(gaps, "query_id", "left")
    ended = F.lit(False)
    if stopped is not None:
        out = out.join(stopped.select("query_id").distinct().withColumn("ended", F.lit(True)), "query_id", "left")
        ended = F.coalesce("ended", F.lit(False))
    has = F.coalesce("has", F.lit(False))
    allowed = F.coalesce("fit", F.lit(False)) & has & F.col("gaps").isNull() & ~ended
    return out.select("query_id", allowed.alias("allowed"), F.when(allowed, "complete").when(has, "partial").otherwise("no_context").alias("coverage_status"))


def partial_context(packed: DataFrame, facets: DataFrame, inspected: DataFrame) -> DataFrame:
    """(query_id, allowed, coverage_status, reason): any packed evidence allows an answer; coverage is certified apart from that.

    inspected lists the query_ids whose evidence was looked at to the end. Without that the status is not_assessed.
    """
    held = packed.select("query_id", ((F.trim("context") != "") & (F.size("chunk_ids") > 0)).alias("allowed"), "chunk_ids")
    gaps = uncovered(facets, held.select("query_id", F.explode("chunk_ids").alias("id"))).groupBy("query_id").agg(F.count(F.lit(1)).alias("gaps"))
    out = held.join(gaps, "query_id", "left").join(inspected.select("query_id").distinct().withColumn("seen", F.lit(True)), "query_id", "left")
    seen = F.coalesce("seen", F.lit(False))
    status = F.when(~F.col("allowed"), "no_context").when(~seen, "not_assessed").when(F.col("gaps").isNull(), "complete").otherwise("partial")
    reason = F.when(status == "complete", None).when(F.col("allowed"), REASONS["partial"]).otherwise(REASONS["no_context"])
    return out.select("query_id", "allowed", status.alias("coverage_status"), reason.alias("reason"))


def flat_context(pages: DataFrame, budget: int, tokens: Callable[[Column], Column] = F.octet_length) -> DataFrame:
    """(query_id, context, truncated) of numbered pages (query_id, position, file, page, text), each of which is taken if it still fits.

    A page without text keeps its number and is left out; repeated pages are one. tokens must add up over joined texts. Only
    sizes are gathered: a question's pages stream by position through a task that keeps what is used, and the texts that it
    chose, which the budget bounds, are joined afterwards. A question whose pages have no text has an empty context.
    """
    page = F.coalesce(F.col("page").cast("string"), F.lit("?"))
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("file"), F.lit(", page "), page, F.lit("\n"), F.col("text"))
    rows = pages.select("query_id", "position", F.when(F.coalesce(F.col("text"), F.lit("")) != "", block).alias("block"))
    sized = rows.select("query_id", "position", F.xxhash64("block").alias("_h"), F.when(F.col("block").isNotNull(), tokens(F.col("block"))).cast("long").alias("size")).distinct()
    ordered = sized.repartition("query_id").sortWithinPartitions("query_id", "position", "_h")
    joint = len(BREAK)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, used, taken, cut = None, 0, 0, False
        started = False
        for batch in batches:
            who, fits, last = [], [], []
            for k, (own, size) in enumerate(zip(batch.column("query_id").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                if not started or own != query:
                    query, used, taken, started = own, 0, 0, True
                who.append(k)
                more = None if size is None else size + (joint if taken else 0)
                fit = more is not None and used + more <= budget
                if fit:
                    used, taken = used + more, taken + 1
                fits.append(fit)
                last.append(more is not None and not fit)
            kept = [batch.column(c) for c in ("query_id", "position", "_h")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fits, pa.bool_()), pa.array(last, pa.bool_())], names=["query_id", "position", "_h", "fits", "over"])

    schema = T.StructType([*(ordered.schema[c] for c in ("query_id", "position", "_h")), T.StructField("fits", T.BooleanType()), T.StructField("over", T.BooleanType())])
    chosen = written(ordered.mapInArrow(choose, schema))
    cut = chosen.groupBy("query_id").agg(F.bool_or("over").alias("truncated"))
    keys = chosen.filter("fits").select(F.col("query_id").alias("_q"), F.col("position").alias("_p"), F.col("_h").alias("_k"))
    same = rows["query_id"].eqNullSafe(F.col("_q")) & (rows["position"] == F.col("_p")) & (F.xxhash64("block") == F.col("_k"))
    texts = rows.join(keys, same).select("query_id", "position", "_k", "block").distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "_k", "block"))), lambda x: x["block"])
    held = texts.groupBy("query_id").agg(F.array_join(listed, BREAK).alias("context")).withColumnRenamed("query_id", "_q")
    met = cut.join(held, cut["query_id"].eqNullSafe(held["_q"]), "left")
    return met.select("query_id", F.coalesce("context", F.lit("")).alias("context"), "truncated")


def flat_citations(chunks: DataFrame, pages: DataFrame, most: float) -> DataFrame:
    """(query_id, position, title, page, page_end, quote): near chunks (query_id, position, distance, title, file, page_start,
    page_end, text), or, for a question without any, its pages (query_id, position, title, file, page, text)."""
    near = chunks.filter(F.coalesce("distance", F.lit(1.0)) <= most)
    first = near.select("query_id", "position", F.coalesce("title", "file").alias("title"), F.col("page_start").alias("page"), F.coalesce("page_end", "page_start").alias("page_end"), F.left("text", F.lit(500)).alias("quote"))
    rest = pages.join(near.select("query_id").distinct(), "query_id", "left_anti")
    none = F.lit(None).cast(dict(chunks.dtypes)["page_end"])
    second = rest.select("query_id", "position", F.coalesce("title", "file").alias("title"), "page", none.alias("page_end"), F.left(F.coalesce("text", F.lit("")), F.lit(300)).alias("quote"))
    return first.unionByName(second)


def route(allowed: Column, response_mode: Column, answer_mode: Column, blocked: Column) -> Column:
    """Whether an answer is written: never where coverage blocks it; where evidence allows it; else in open chats alone."""
    open_chat = ~response_mode.eqNullSafe(F.lit("policymaker")) & answer_mode.eqNullSafe(F.lit("chat"))
    return F.when(F.coalesce(blocked, F.lit(False)), "insufficient_evidence").when(F.coalesce(allowed, F.lit(False)) | open_chat, "generate_answer").otherwise("insufficient_evidence")


def losses(candidates: DataFrame, selected: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, n_candidates, n_selected, n_packed, lost): selected ids (query_id, id) that weren't packed, in order."""
    n = lambda df, name: df.groupBy("query_id").agg(F.countDistinct("id").alias(name))
    lost = selected.join(packed, ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("lost"))
    out = n(candidates, "n_candidates").join(n(selected, "n_selected"), "query_id", "left").join(n(packed, "n_packed"), "query_id", "left").join(lost, "query_id", "left")
    return out.fillna(0, ["n_selected", "n_packed"]).withColumn("lost", F.coalesce("lost", F.array().cast(lost.schema["lost"].dataType)))


def follow_ups(candidates: DataFrame, found: DataFrame, cutoff: float, floor: float | None = None, limit: int = 3) -> DataFrame:
    """(query_id, position, text): of suggested questions (query_id, position, text) the first that evidence backs.

    found has query_id, position, distance and score of what each one's own search brought; the nearest must be within the
    cutoff, and the best score reach the floor, if one is given.
    """
    best = found.groupBy("query_id", "position").agg(F.min(F.coalesce("distance", F.lit(1.0))).alias("d"), F.max("score").alias("s"))
    backed = best.filter((F.col("d") <= cutoff) & (F.lit(True) if floor is None else F.coalesce(F.col("s") >= floor, F.lit(False))))
    met = candidates.join(backed.select("query_id", "position"), ["query_id", "position"])
    from .search import top_k

    return top_k(met, ["query_id"], ["position"], limit, "_n").drop("_n")


def fresh_questions(candidates: DataFrame, asked: DataFrame, pool: int, size: int = 200) -> DataFrame:
    """(query_id, position, text): candidates cut to size, blank ones and those asked before (query_id, text) left out, each key once, pool at most."""
    from ..functions.text import cut_question, loose_key
    from .search import top_k

    keyed = candidates.select("query_id", "position", cut_question(F.col("text"), size).alias("text")).withColumn("key", loose_key(F.col("text"))).filter("key <> ''")
    before = asked.select("query_id", loose_key(F.col("text")).alias("key")).distinct()
    first = keyed.join(before, ["query_id", "key"], "left_anti").groupBy("query_id", "key").agg(F.min(F.struct("position", "text")).alias("m"))
    return top_k(first.select("query_id", "m.position", "m.text"), ["query_id"], ["position"], pool, "_n").drop("_n")
