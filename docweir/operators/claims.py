"""Answers held against their evidence: reviews applied, claims and citations resolved, anchors restored, what a trace shows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import batched

#: What a review can say of a unit, and of an answer.
STATES = ("supported", "partial", "unsupported", "contradicted", "gap", "non_factual")
VERDICTS = ("pass_complete", "pass_partial", "needs_revision", "fail_critical")
MARK = re.compile(r"\[(\d+)\]")


def unit_fault(state: str, text: str, bindings: list[tuple[int, str]], sources: dict[int, str]) -> str | None:
    """Why a reviewed unit can't stay, or None: a supported one needs exact quotes of its sources, a gap cites nothing, and
    only headings and labels are free of proof."""
    if state == "supported":
        for number, quote in bindings:
            if number not in sources or not (quote or "").strip():
                return "invalid binding"
            if quote not in sources[number]:
                return "quote is not in its source"
        return None if bindings else "no binding"
    if state == "gap":
        return "a gap cites a source" if MARK.search(text) else None
    if state == "non_factual":
        bare = text.strip()
        label = len(text) < 100 and (text.rstrip("*").endswith(":") or bool(re.fullmatch(r"\*\*[^\n]+\*\*", bare)))
        return None if bare.startswith("#") or label else "prose without proof"
    return "not supported"


def rebound(text: str, numbers: list[int]) -> str:
    """The unit's text citing exactly these numbers; as it is where it does."""
    if {int(n) for n in MARK.findall(text)} == set(numbers):
        return text
    return MARK.sub("", text).rstrip() + " " + "".join(f"[{n}]" for n in dict.fromkeys(numbers))


def review_answer(units: list[tuple[str, str]], reviews: dict[str, tuple[str, list[tuple[int, str]]]], sources: dict[int, str]) -> dict[str, object]:
    """What is left of an answer after its review: headings stay where something below them does.

    units are (id, text) in order, reviews has each one's state and bindings. A review that doesn't cover every unit once,
    an unknown state, or no content left make an error and no answer.
    """
    out = {"answer": None, "removed": [], "rebound": [], "faults": {}, "error": None}
    if reviews.keys() != {i for i, _ in units}:
        return out | {"error": "the review doesn't cover every unit once"}
    if any(state not in STATES for state, _ in reviews.values()):
        return out | {"error": "unknown state"}
    kept, waiting, content = [], [], 0
    for i, text in units:
        state, bindings = reviews[i]
        if fault := unit_fault(state, text, bindings, sources):
            out["removed"].append(i)
            if state in ("supported", "gap"):
                out["faults"][i] = fault
            continue
        if state == "non_factual":
            waiting.append(text)
            continue
        made = rebound(text, [n for n, _ in bindings]) if state == "supported" else text
        if made != text:
            out["rebound"].append(i)
        kept += [*(waiting if state == "supported" else []), made] if state == "supported" else [*waiting, made]
        waiting, content = [], content + 1
    if not content:
        return out | {"error": "no content is left"}
    return out | {"answer": "\n\n".join(kept)}


def apply_reviews(units: DataFrame, reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, answer, removed, rebound, faults, error) by review_answer() for each answer.

    units has answer_id, position, unit, text; reviews answer_id, unit, state, bindings (array of number, quote); sources
    answer_id, number, quote. A unit reviewed twice, or not at all, is an error of its answer.
    """
    n = reviews.groupBy("answer_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.first("state").alias("state"), F.first("bindings").alias("bindings"))
    rows = units.join(n, ["answer_id", "unit"], "left").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("position", "unit", "text", "state", "n", "bindings"))).alias("units"))
    extra = reviews.join(units, ["answer_id", "unit"], "left_anti").groupBy("answer_id").agg(F.count(F.lit(1)).alias("extra"))
    own = sources.groupBy("answer_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("number", "quote")))).alias("sources"))
    met = rows.join(own, "answer_id", "left").join(extra, "answer_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                seen = {} if r.extra and r.extra > 0 else {u["unit"]: (u["state"], [(b["number"], b["quote"]) for b in (u["bindings"] if u["bindings"] is not None else [])]) for u in r.units if u["n"] == 1}
                sources_ = {int(k): v for k, v in (r.sources.items() if isinstance(r.sources, dict) else r.sources or [])}
                made = review_answer([(u["unit"], u["text"]) for u in r.units], seen, sources_)
                out.append((r.answer_id, *made.values()))
            yield pd.DataFrame(out, columns=["answer_id", "answer", "removed", "rebound", "faults", "error"])

    kind = dict(units.dtypes)["answer_id"]
    return batched(met).mapInPandas(run, f"answer_id {kind}, answer string, removed array<string>, rebound array<string>, faults map<string,string>, error string")


def citation_records(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, number, id, document_id, title, page, page_end, quote, resolved) of citations (answer_id, position, number, id, ...).

    A citation without a number has its place, from 1; what it lacks comes from its chunk (id, document_id, title, file, page,
    page_end, text). One with neither a chunk nor a url is unresolved.
    """
    raw = chunks.select(*(F.col(c).alias(f"_{c}") for c in ("id", "document_id", "title", "file", "page", "page_end", "text")))
    met = citations.join(raw, citations["id"] == F.col("_id"), "left")
    return met.select(
        "answer_id", F.coalesce("number", "position").alias("number"), "id", F.coalesce("document_id", "_document_id").alias("document_id"), F.coalesce("title", "_title", "_file").alias("title"),
        F.coalesce("page", "_page").alias("page"), F.coalesce("page_end", "_page_end").alias("page_end"), F.coalesce("quote", "_text").alias("quote"), (F.col("id").isNotNull() | F.col("source_url").isNotNull()).alias("resolved"),
    )


def claim_evidence(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(answer_id, claim, ids, quotes, resolved, unresolved) of claims (answer_id, claim, numbers): evidence in the order of the numbers."""
    each = claims.select("answer_id", "claim", F.posexplode_outer("numbers").alias("at", "number"))
    met = each.join(records.select("answer_id", "number", F.col("id").alias("_id"), "quote", F.lit(True).alias("known")), ["answer_id", "number"], "left")
    found = F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("at", "_id", "quote"))))
    lost = F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("number"))))
    out = met.groupBy("answer_id", "claim").agg(found.alias("f"), lost.alias("unresolved"))
    return out.select("answer_id", "claim", F.transform("f", lambda x: x["_id"]).alias("ids"), F.transform("f", lambda x: x["quote"]).alias("quotes"), (F.size("unresolved") == 0).alias("resolved"), "unresolved")


def review_problems(reviews: DataFrame, claims: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, status, problems) of saved reviews (answer_id, verdict): an unknown verdict is invalid, a claim whose span isn't
    in the answer or whose numbers aren't those of its citations needs a decision.

    claims has answer_id, span, numbers, answers answer_id, text, n_citations.
    """
    met = claims.join(answers, "answer_id")
    found = F.array_compact(F.array(
        F.when((F.coalesce(F.col("span"), F.lit("")) == "") | ~F.contains("text", F.col("span")), "claim_span_not_exact"),
        F.when(F.exists("numbers", lambda n: n.isNull() | (n < 1) | (n > F.col("n_citations"))), "citation_out_of_range"),
    ))
    own = met.select("answer_id", F.explode(found).alias("p")).groupBy("answer_id").agg(F.array_sort(F.collect_set("p")).alias("problems"))
    out = reviews.join(own, "answer_id", "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    status = F.when(~F.col("verdict").isin(*VERDICTS) | F.col("verdict").isNull(), "invalid").when(F.size("problems") > 0, "needs_adjudication").otherwise("reviewed")
    return out.select("answer_id", status.alias("status"), "problems")


def cited_tiers(sources: DataFrame, citations: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, position, tier) of the kinds of evidence (answer_id, position, tier) that the answer's numbers cite.

    A find in the full corpus counts as internal, so not here, where an internal citation has its document.
    """
    from ..functions.text import citation_numbers

    cited = answers.select("answer_id", F.explode(F.array_distinct(citation_numbers(F.col("text")))).alias("number"))
    inside = citations.filter("tier = 'internal' and document_id is not null").select("answer_id", "document_id", F.lit(True).alias("inside")).distinct()
    used = citations.join(cited, ["answer_id", "number"]).join(inside, ["answer_id", "document_id"], "left")
    own = used.filter(F.col("tier").isNotNull() & ~((F.col("tier") == "full_corpus") & F.coalesce("inside", F.lit(False)))).select("answer_id", "tier").distinct()
    return sources.join(own, ["answer_id", "tier"], "left_semi").select("answer_id", "position", "tier")


def tool_event(content: Column, most: int = 5) -> dict[str, Column]:
    """What a trace shows of a tool's JSON result: how many results it has, their first distinct titles, and its verdict."""
    results = F.from_json(F.get_json_object(content, "$.results"), "array<struct<title:string>>")
    titles = F.array_distinct(F.filter(F.transform(results, lambda r: r["title"]), lambda t: t.isNotNull() & (t != "")))
    text = lambda k: F.get_json_object(content, f"$.{k}")
    return {
        "result_count": F.when(results.isNotNull(), F.size(results)), "source_titles": F.coalesce(F.slice(titles, 1, most), F.array().cast("array<string>")),
        "evidence_sufficient": text("evidence_sufficient").cast("boolean"), "evidence_reason": F.coalesce(F.nullif(text("reason"), F.lit("")), text("error")),
    }


def restored(anchor: str, question: str) -> str | None:
    """An anchor as it stands in the question: word for word, else its only place but for case; else None."""
    if not anchor.strip() or anchor in question:
        return anchor if anchor.strip() else None
    want, folded, at = anchor.casefold(), [], [0]
    for c in question:  # folding may make several characters of one
        folded.append(c.casefold())
        at.append(at[-1] + len(folded[-1]))
    place, text, found = {n: k for k, n in enumerate(at)}, "".join(folded), None
    k = text.find(want)
    while k >= 0:
        if k in place and k + len(want) in place:
            if found is not None:
                return None
            found = question[place[k] : place[k + len(want)]]
        k = text.find(want, k + 1)
    return found


def restore_anchors(anchors: DataFrame) -> DataFrame:
    """anchors (query_id, position, question, anchor) with restored: the anchor as the question has it, null where it can't be told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(restored=[restored(a or "", q or "") for a, q in zip(batch["anchor"], batch["question"], strict=True)])

    kinds = dict(anchors.dtypes)
    columns = ["query_id", "position", "question", "anchor"]
    return batched(anchors.select(*columns)).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "restored string"]))


def resolve_references(references: DataFrame, spans: DataFrame) -> DataFrame:
    """references (ref, query_id, span_id, id, quote) with found: the span they name, if chunk and quote agree with it, else the
    first span of their chunk that holds their quote.

    spans has query_id, span_id, position, id, quote.
    """
    s = spans.select(*(F.col(c).alias(f"_{c}") for c in ("query_id", "span_id", "position", "id", "quote")))
    own, r = F.col("query_id") == F.col("_query_id"), references
    agrees = (F.col("id").isNull() | (F.col("id") == F.col("_id"))) & (F.col("quote").isNull() | (F.col("quote") == F.col("_quote")))
    holds = (F.trim("quote") != "") & F.contains("_quote", F.col("quote"))
    # a reference names a span or a chunk, so it meets the spans by one of two keys
    named = r.filter("span_id is not null").join(s, own & (F.col("span_id") == F.col("_span_id")) & agrees, "left")
    quoted = r.filter("span_id is null").join(s, own & (F.col("id") == F.col("_id")) & holds, "left")
    return named.unionByName(quoted).groupBy(*references.columns).agg(F.min_by("_span_id", "_position").alias("found"))


def gap_queries(gaps: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, place, requirement, text): searches for what evidence lacks, at most so many for each question, none twice.

    gaps has query_id, position, requirement, question, anchors and terms (array of term, source, grounded): terms are
    used only if each of them stands in what it was taken from.
    """
    from .search import top_k

    grounded = F.forall("terms", lambda t: F.coalesce(t["grounded"], F.lit(False)))
    words = F.array_distinct(F.transform("terms", lambda t: t["term"]))
    base = F.concat(F.col("question"), F.lit("\nRequirement "), F.col("requirement"), F.lit(": "), F.array_join("anchors", " "))
    text = F.when((F.size("terms") > 0) & grounded, F.concat(base, F.lit("\nEvidence terms: "), F.array_join(words, "; "))).otherwise(base)
    made = gaps.select("query_id", "position", "requirement", text.alias("text"))
    first = made.groupBy("query_id", F.lower("text").alias("key")).agg(F.min(F.struct("position", "requirement", "text")).alias("m")).select("query_id", "m.*")
    return top_k(first, ["query_id"], ["position"], most, "place").select("query_id", "place", "requirement", "text")


