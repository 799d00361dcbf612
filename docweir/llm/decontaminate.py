"""Benchmark decontamination: an FM-index for each training shard, searched backwards for the benchmark's windows.

A shard is up to SHARD_ROWS documents of one Arrow batch. Its words become symbols of the benchmark's vocabulary; a word outside that
vocabulary ends a run, and runs shorter than the shortest window hold no window, so they stay out of the index. The
suffixes of the remaining runs are sorted in full, the Burrows-Wheeler transform goes into a wavelet tree, all windows
are searched backwards by its ranks at once, and occurrences are located by walking back to sampled suffix positions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, blocks, table

WINDOW = 13
#: Bytes of benchmark text that one broadcast holds; a larger benchmark is searched in several passes.
BLOCK_BYTES = 16_000_000
SAMPLE_EVERY = 16
#: Documents of a training shard at most.
SHARD_ROWS = 2048
#: The word class of UTF-8 bytes after A-Z are lower-cased: digits, letters and whatever is not ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
FOUND = "_dw_n_words long, _dw_spans array<struct<start:long,end:long>>, _dw_items array<string>"


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit, each level stably split by its bit."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the given place."""
        start = np.zeros_like(before)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            before = np.where(bit, zeros + ones[before], before - ones[before])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return before - start


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. Symbol 0 ends a run; each such end is a symbol of its own, by place."""
    n, ends = len(text), text == 0
    m = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + m)
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else ahead[: n - step]
        key = rank * (int(max(rank.max(), ahead.max())) + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, step = fresh, 2 * step
        if rank.max() == n - 1 or step >= 2 * n:
            return order


class FMIndex:
    """Over runs of symbols from 1 up, each run followed by a 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = sort_suffixes(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # a walk back must not pass the start of a run, so those positions are sampled too
        sampled = (order % SAMPLE_EVERY == 0) | (self.bwt == 0)
        self.sample = np.where(sampled, order, -1)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each of the windows, which are of one length."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        alive = np.arange(len(windows))
        for k in reversed(range(windows.shape[1])):
            c = windows[alive, k]
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        at, position = rows.copy(), np.full(len(rows), -1, np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            known = self.sample[at[open_]]
            done = known >= 0
            position[open_[done]] = known[done] + steps
            open_ = open_[~done]
            c = self.bwt[at[open_]]
            at[open_] = self.first[c] + self.tree.rank(c, at[open_])
            steps += 1
        return position


class Windows:
    """The distinct windows of some benchmark items, by length, with the items that hold each."""

    def __init__(self, items: Iterable[tuple[str, bytes]], size: int = WINDOW) -> None:
        self.codes: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.codes.setdefault(w, len(self.codes) + 1) for w in WORDS(text.lower())]
            for k in range(max(1, len(words) - size + 1) if words else 0):
                held.setdefault(tuple(words[k : k + size]), set()).add(item)
        self.lengths: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for length in sorted({len(w) for w in held}):
            own = [w for w in held if len(w) == length]
            self.lengths[length] = np.array(own, np.int64).reshape(len(own), length), [sorted(held[w]) for w in own]
        self.shortest = min(self.lengths, default=0)

    def find(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: its number of words, merged spans of hit words [start, end), and the items that occur."""
        n_words, runs, where = [], [], []
        for k, text in enumerate(texts):
            words = WORDS(text.lower()) if text else []
            n_words.append(len(words))
            if self.shortest and len(words) >= self.shortest:
                codes = np.fromiter(map(self.codes.get, words, repeat(0)), np.int64, len(words))
                edge = np.flatnonzero(np.diff(codes > 0, prepend=False, append=False))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if b - a >= self.shortest:
                        runs.append(codes[a:b])
                        where.append((k, a, b - a))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if not runs:
            return n_words, spans, items
        text = np.zeros(sum(map(len, runs)) + len(runs), np.int64)
        starts = np.cumsum([0, *(len(r) + 1 for r in runs)])[:-1]
        for a, r in zip(starts.tolist(), runs, strict=True):
            text[a : a + len(r)] = r
        index = FMIndex(text, len(self.codes))
        doc = np.array([w[0] for w in where])
        change = np.zeros(len(text) + 1, np.int64)
        for length, (windows, holders) in self.lengths.items():
            low, high = index.search(windows)
            count = high - low
            if not count.any():
                continue
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            at = index.locate(rows)
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            which = np.repeat(np.arange(len(windows)), count)
            pairs = np.unique(np.stack([doc[np.searchsorted(starts, at, "right") - 1], which]), axis=1)
            for d, w in pairs.T.tolist():
                items[d].update(holders[w])
        hit = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            run = int(np.searchsorted(starts, a, "right")) - 1
            k, offset, _ = where[run]
            spans[k].append((offset + a - int(starts[run]), offset + b - int(starts[run])))
        return n_words, spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not said) with _dw_n_words, _dw_spans (hit words, merged, [start, end)) and _dw_items.

    docs has a column text, benchmark has item_id and text. Each row is judged by itself, repeated rows alike. Null and
    empty texts have no words and no spans; items without words have no window; an empty benchmark hits nothing. The
    benchmark is sent to the tasks in blocks of BLOCK_BYTES, one pass over the documents for each block.
    """
    keep = list(docs.columns if keep is None else keep)
    spark = docs.sparkSession
    columns, out, passes = [*dict.fromkeys([*keep, "text"])], docs, 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = blocks(items.filter("item_id is not null"), lambda r: len(r.text) + 100, BLOCK_BYTES)
    for block in chain([next(found, [])], found):
        sent = spark.sparkContext.broadcast(Windows([(r.item_id, bytes(r.text)) for r in block]))

        def search(batch: pa.RecordBatch, sent=sent, again=passes > 0) -> dict[str, object]:
            n_words, spans, items = sent.value.find(batch.column("text").cast(pa.binary()).to_pylist())
            if again:
                old = batch.column("_dw_spans").to_pylist(), batch.column("_dw_items").to_pylist()
                spans = [merged([*s, *((x["start"], x["end"]) for x in o)]) for s, o in zip(spans, old[0], strict=True)]
                items = [i | set(o) for i, o in zip(items, old[1], strict=True)]
            return {
                "_dw_n_words": n_words,
                "_dw_spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
                "_dw_items": [sorted(i) for i in items],
            }

        if passes:
            again = [*columns, "_dw_spans", "_dw_items"]
            out = arrow_map(out.select(*again), search, FOUND, again, SHARD_ROWS)
        else:
            out = arrow_map(docs.select(*columns), search, FOUND, columns, SHARD_ROWS)
        passes += 1
    return out.select(*keep, "_dw_n_words", "_dw_spans", "_dw_items")


def judged(found: DataFrame) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated to what find_contamination() returns."""
    hit = F.aggregate("_dw_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return (
        found.withColumn("n_words", F.col("_dw_n_words"))
        .withColumn("n_hit", hit)
        .withColumn("n_items", F.size("_dw_items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("_dw_items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, hit words, items and verdict against the benchmark table."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute_force(text: str | None, items: list[tuple[str, str]]) -> tuple[int, int, int, str, bool]:
    """What op1 returns of one text, by comparing every window everywhere; for tests."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
            part = w[k : k + WINDOW]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(item)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 g AS (SELECT DISTINCT item, w[i : i + {WINDOW - 1}] AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)),
 n AS (SELECT DISTINCT len(g) AS n FROM g),
 s AS (SELECT doc_id, i, n, w[i : i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, n WHERE len(w) >= n)),
 o AS (SELECT doc_id, i, n, item FROM s JOIN g USING (g)),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM o) GROUP BY 1),
 m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""
