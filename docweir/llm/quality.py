"""Quality from weak labels: heuristic labellers vote, EM estimates how far to trust each, and a hashed linear scorer learns.

Every document gets the vote of each labeller (good, bad or none). There are at most 3 ** labellers patterns of votes,
so the counts of the patterns over all documents hold all that expectation-maximisation needs. It estimates each labeller's
accuracy and the share of good documents without any given label; the posterior of its pattern is a document's label.
A linear scorer over hashed words and word shapes is trained on the posteriors of a sample, which at most TRAIN_ROWS
documents and TRAIN_FEATURES counts of their features bound, and scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, table

#: The bounds of the sample that the scorer is trained on: documents, and counts of distinct features of whole documents.
TRAIN_ROWS, TRAIN_FEATURES = 6_000, 4_000_000
HASH_BITS = 18
KEEP = 0.5
REMEMBERED = 150_000
GOOD, BAD, NONE = "1", "0", "-"
#: Function words of the corpus's languages.
FUNCTION_WORDS = frozenset("the of and to in a is that for it as with was on be by der die und das den von zu mit sich auf für nicht le la les de et des un une est que en el los las y del se por con para".split())


@dataclass
class Look:
    """What the labellers see of a text, measured once."""

    text: str

    def __post_init__(self) -> None:
        t = self.text
        self.words = t.split()
        self.n = len(self.words)
        self.letters = sum(map(len, re.findall(r"[^\W\d_]+", t)))
        self.counts = Counter(self.words)
        self.again = sum(map(eq, self.words, self.words[1:]))
        self.lines = [x for x in t.split("\n") if x.strip()]

    def share(self, part: float) -> float:
        return part / max(1, self.n)


def _bad(fires: bool) -> str:
    """A detector of one kind of junk: where it is silent it says nothing, since the text may be junk of another kind."""
    return BAD if fires else NONE


def _symbols(x: Look) -> str:
    return _bad(x.share(sum(x.text.count(c) for c in "#$%&*<>{}~^\\")) > 0.15)


def _marked_words(x: Look) -> str:
    return _bad(x.share(sum(1 for w in x.words if len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum())) > 0.1)


def _few_letters(x: Look) -> str:
    return _bad(x.letters / max(1, len(x.text) - x.text.count(" ")) < 0.75)


def _shouting(x: Look) -> str:
    return _bad(sum(map(len, UPPER.findall(x.text))) > 0.2 * x.letters)


def _exclaiming(x: Look) -> str:
    return _bad(x.share(x.text.count("!")) > 0.1)


def _cells(x: Look) -> str:
    return _bad(x.share(x.text.count("|")) > 0.05)


def _lone_signs(x: Look) -> str:
    return _bad(x.share(sum(1 for w in x.words if len(w) == 1 and not w.isalnum())) > 0.05)


def _stutter(x: Look) -> str:
    return _bad(x.n >= 10 and x.share(x.again) > 0.1)


def _few_words(x: Look) -> str:
    return _bad(x.n >= 30 and (max(x.counts.values()) > 0.2 * x.n or len(x.counts) < 0.1 * min(x.n, 2000)))


def _lines_again(x: Look) -> str:
    return _bad(len(x.lines) >= 4 and len(set(x.lines)) < 0.7 * len(x.lines))


def _packs(x: Look) -> str:
    return _bad(x.n >= 30 and len(zlib.compress(x.text.encode(), 1)) < 0.25 * len(x.text))


def _function_words(x: Look) -> str:
    if x.n < 20 or x.again > 0.1 * x.n:  # repeated words say nothing of running text
        return NONE
    plain = x.share(sum(n for w, n in x.counts.items() if w.lower() in FUNCTION_WORDS))
    return BAD if plain < 0.03 else GOOD if plain > 0.1 else NONE


def _sentences(x: Look) -> str:
    if x.n < 20 or x.again > 0.1 * x.n:
        return NONE
    ends = x.share(sum(n for w, n in x.counts.items() if w[-1] in ".?"))
    return BAD if ends < 0.005 else GOOD if 0.03 < ends < 0.4 else NONE


UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
LABELLERS: list[Callable[[Look], str]] = [
    _symbols, _marked_words, _few_letters, _shouting, _exclaiming, _cells, _lone_signs, _stutter, _few_words, _lines_again, _packs, _function_words, _sentences,
]


def votes(text: str | None) -> str:
    look = Look(text or "")
    return "".join(f(look) for f in LABELLERS)


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], list[float], float]:
    """Posterior of each pattern, accuracy of each labeller, share of good rows, by EM over independent labellers.

    An accuracy is how often a labeller's vote, when it gives one, is right. A labeller that never votes stays near its
    start. Most documents are taken to be good, so the share is at least one half; without rows it is that.
    """
    names = sorted(patterns)
    m = len(names[0]) if names else 0
    n = np.array([patterns[p] for p in names], float)
    vote = np.array([[{GOOD: 1, BAD: 0, NONE: -1}[c] for c in p] for p in names]).reshape(len(names), m)
    share = 0.8
    post = np.full(len(names), share)
    accuracy = np.full(m, 0.9)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        z = math.log(share / (1 - share)) + np.where(vote == 1, odds, np.where(vote == 0, -odds, 0.0)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        right = (n[:, None] * np.where(vote == 1, post[:, None], np.where(vote == 0, 1 - post[:, None], 0.0))).sum(0)
        # ten pseudo-votes, nine of them right, keep a labeller from certainty and the classes from changing places
        accuracy = np.clip((right + 9) / ((n[:, None] * (vote >= 0)).sum(0) + 10), 0.55, 0.995)
        share = float(np.clip((n * post).sum() / max(1.0, n.sum()), 0.5, 0.95)) if len(names) else 0.5
    return dict(zip(names, post.tolist(), strict=True)), accuracy.tolist(), share


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def features(word: str) -> tuple[int, int]:
    """Places of a word and of its shape among 2 ** HASH_BITS weights."""
    mask = (1 << HASH_BITS) - 1
    return zlib.crc32(b"w" + word.lower().encode()) & mask, zlib.crc32(b"s" + _shape(word).encode()) & mask


#: The weight of a word that is the one before it again.
AGAIN = zlib.crc32(b"again") & ((1 << HASH_BITS) - 1)


def places(text: str | None) -> dict[int, int]:
    """How often each feature of a text occurs; repeated words add one more each."""
    words = (text or "").split()
    out: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for p in features(w):
            out[p] += n
    if again := sum(map(eq, words, words[1:])):
        out[AGAIN] += again
    return out


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        if not words:
            return 0.0
        known, total = self.known, float(self.weights[AGAIN]) * sum(map(eq, words, words[1:]))
        for w in words:
            v = known.get(w)
            if v is None:
                if len(known) > REMEMBERED:
                    known.clear()
                a, b = features(w)
                v = known[w] = float(self.weights[a] + self.weights[b])
            total += v
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + total / len(words)))))


def train(y: np.ndarray, sizes: np.ndarray, place: np.ndarray, count: np.ndarray, words: np.ndarray, rounds: int = 60, rate: float = 40.0, decay: float = 1e-5) -> Scorer:
    """Logistic regression of posteriors y on hashed features a word: sizes[k] places and counts belong to row k of so many words.

    By full gradients, with a step scaled by each feature's use.
    """
    weights, bias = np.zeros(1 << HASH_BITS), 0.0
    if len(y):
        own = np.repeat(np.arange(len(y)), sizes)
        value = count / np.repeat(np.maximum(words, 1), sizes)
        bias = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        scale = np.sqrt(np.bincount(place, value * value / np.maximum(count, 1), 1 << HASH_BITS)) + 1e-3
        for _ in range(rounds):
            z = np.bincount(own, weights[place] * value, len(y)) + bias
            error = y - 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            weights += rate * np.bincount(place, value * error[own], 1 << HASH_BITS) / scale / len(y) ** 0.5 - decay * weights
            bias += error.mean()
    return Scorer(weights, bias)


def label_votes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, votes) of each row, in the shared folder; digest is that of the text."""

    def vote(batch: pa.RecordBatch) -> dict[str, object]:
        return {"votes": [votes(t) for t in batch.column("text").to_pylist()]}

    return cut(arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")), vote, "votes string", ["doc_id", "digest"]))


def _sample(docs: DataFrame, voted: DataFrame, posterior: dict[str, float]) -> tuple[np.ndarray, ...]:
    """What train() takes, of the first rows by a hash, each (doc_id, text) once."""
    own = docs.sparkSession.sparkContext.broadcast(posterior)
    order = [F.xxhash64("doc_id", "digest"), "doc_id", "digest"]
    chosen = voted.filter("doc_id is not null").groupBy("doc_id", "digest").agg(F.min("votes").alias("votes")).orderBy(*order).limit(TRAIN_ROWS)

    def featured(batch: pa.RecordBatch) -> dict[str, object]:
        texts = batch.column("text").to_pylist()
        found = [places(t) for t in texts]
        return {
            "label": [own.value[v] for v in batch.column("votes").to_pylist()], "places": [[*f] for f in found], "counts": [[*f.values()] for f in found],
            "words": [len((t or "").split()) for t in texts], "n": [len(f) for f in found],
        }

    chosen = chosen.withColumnsRenamed({"doc_id": "_dw_id", "digest": "_dw_of"})
    met = (F.col("doc_id") == F.col("_dw_id")) & (F.xxhash64("text") == F.col("_dw_of"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), met)  # TRAIN_ROWS bounds it
    rows = rows.groupBy("doc_id", F.col("_dw_of").alias("digest")).agg(F.first("text").alias("text"), F.first("votes").alias("votes"))
    rows = cut(arrow_map(rows, featured, "label double, places array<int>, counts array<int>, words int, n int", ["doc_id", "digest"]))
    sizes, total, last = rows.select(*order, "n").orderBy(*order).collect(), 0, None  # TRAIN_ROWS small rows
    for r in sizes:
        total += r.n
        if total > TRAIN_FEATURES:
            break
        last = r
    if last is None:
        return tuple(np.zeros(0, t) for t in (float, np.int64, np.int64, float, float))
    first = F.col("h") <= F.lit(last[0])  # rows of equal hashes go together, which is one row but for chance
    made = rows.withColumn("h", order[0]).filter(first).orderBy(*order).select("label", "places", "counts", "words").toArrow().combine_chunks()
    flat = lambda c, t: made.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(t)
    column = lambda c: made.column(c).to_numpy()
    lengths = np.array([len(x) for x in made.column("places")], np.int64)
    return column("label"), lengths, flat("places", np.int64), flat("counts", float), column("words")


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for each row, by the whole text.

    Null and empty texts score 0 and aren't kept; a score of exactly KEEP is. Rows of one doc_id with several texts are
    judged by their own text, repeated rows alike and counted as often as they are there, except in the sample. Other
    columns are not read; an empty table gives no rows.
    """
    voted = label_votes(docs)
    patterns = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3 ** labellers at most
    posterior, _, _ = estimate(patterns)
    sent = docs.sparkSession.sparkContext.broadcast(train(*_sample(docs, voted, posterior)))

    def score(batch: pa.RecordBatch) -> dict[str, object]:
        return {"score": [sent.value.score(t) for t in batch.column("text").to_pylist()]}

    out = arrow_map(docs.select("doc_id", "text"), score, "score double", ["doc_id"])
    return out.withColumn("keep", F.col("score") >= KEEP)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score and whether it is kept."""
    return classify(table(spark, sf_dir, "documents"))
