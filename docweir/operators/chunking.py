"""Chunks of documents under a token budget, with overlap.

A document becomes a list of parts, each with its tokens: paragraphs that fit whole, else groups of their sentences, else
slices. Running sums over the parts give every chunk's end, and where its overlap begins, by bisection.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from .tables import batched

SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")
Count = Callable[[str], int]
Part = tuple[str, int]


def count_words(text: str) -> int:
    return len(text.split())


def reach(text: str, at: int, budget: int, count: Count, step: int = 1) -> int:
    """How far a slice from at on (to its left, if step is -1) can go within the budget; a slice has one character at least.

    Lengths are doubled until the budget is passed, and the last doubling is bisected, so the cost follows the slice.
    """
    room = len(text) - at if step > 0 else at
    slice_ = lambda n: text[at : at + n] if step > 0 else text[at - n : at]
    fits = lambda n: count(slice_(n)) <= budget
    low = 1
    while low < room and fits(min(room, 2 * low)):
        low = min(room, 2 * low)
    return low + bisect_left(range(low + 1, min(room, 2 * low) + 1), True, key=lambda n: not fits(n))


def sentences(paragraph: str, budget: int, count: Count) -> Iterator[Part]:
    """Sentences with their tokens; one over the budget in slices."""
    for sentence in filter(None, map(str.strip, SENTENCE_END.split(paragraph))):
        size = count(sentence)
        if size <= budget:
            yield sentence, size
            continue
        at = 0
        while at < len(sentence):
            end = at + reach(sentence, at, budget, count)
            if piece := sentence[at:end].strip():
                yield piece, count(piece)
            at = end


def parts_of(paragraph: str, budget: int, count: Count) -> Iterator[Part]:
    """A paragraph whole, if it fits, else as many of its sentences at a time as do."""
    size = count(paragraph)
    if size <= budget:
        yield paragraph, size
        return
    each = list(sentences(paragraph, budget, count))
    sums = [0, *accumulate(n for _, n in each)]
    at = 0
    while at < len(each):
        end = max(at + 1, bisect_right(sums, sums[at] + budget) - 1)
        text = " ".join(t for t, _ in each[at:end])
        yield text, count(text)
        at = end


def tail(text: str, budget: int, count: Count) -> list[Part]:
    """The last sentences of a text that stay within the budget; without any, its last characters."""
    each = list(sentences(text, budget, count))
    sums = [0, *accumulate(n for _, n in each)]
    first = bisect_left(sums, sums[-1] - budget)
    out = " ".join(t for t, _ in each[first:]) or text[len(text) - reach(text, len(text), budget, count, -1) :].strip()
    return [(out, n)] if out and (n := count(out)) <= budget else []


def chunks_of(text: str | None, largest: int = 480, overlap: int = 120, count: Count = count_words) -> list[Part]:
    """(text, tokens) of a document's chunks. Every part leaves room for the overlap before it, so no chunk is over largest.

    largest is 64 at least, the overlap half of it at most; a chunk begins with what the one before ended with.
    """
    largest = max(largest, 64)
    overlap = min(max(overlap, 0), largest // 2)
    paragraphs = filter(None, (" ".join(p.split()) for p in re.split(r"\n\s*\n+", text or "")))
    parts = [part for p in paragraphs for part in parts_of(p, largest - overlap, count)]
    sums = [0, *accumulate(n for _, n in parts)]
    out: list[Part] = []
    fresh, again, lead = 0, 0, []  # the first part that is new, the first that is repeated, and a tail instead of parts
    while fresh < len(parts):
        used = sum(n for _, n in lead)
        end = max(fresh + 1, bisect_right(sums, sums[again] + largest - used) - 1)
        out.append(("\n\n".join(t for t, _ in [*lead, *parts[again:end]]), used + sums[end] - sums[again]))
        again = max(again, bisect_left(sums, sums[end] - overlap)) if overlap else end
        lead = tail(parts[end - 1][0], overlap, count) if again >= end and overlap else []
        fresh, again = end, min(again, end)
    return out


def chunk(docs: DataFrame, largest: int = 480, overlap: int = 120, count: Count = count_words) -> DataFrame:
    """(doc_id, chunk, text, tokens) for each document of docs (doc_id, text); documents are split one by one, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, t, n) for i, text in zip(batch["doc_id"], batch["text"], strict=True) for k, (t, n) in enumerate(chunks_of(text, largest, overlap, count))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text", "tokens"])

    return batched(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk int, text string, tokens int")
