"""Toxicity of whole texts, scored after a noisy-channel decoder has restored disguised words.

The channel writes letters as look-alike signs, repeats them, and puts separators between them. Every reading of a
token that shows such marks, however long, is a path through a lattice of characters; Viterbi's algorithm takes the
likeliest path under a letter trigram model counted over all texts of the corpus. Tokens without such marks have one path, which is
themselves; so have two words that may be one with a gap in it, since plain text is full of such pairs. Restored words and their beginnings are evidence; at most TRAIN_ROWS labelled rows, near copies taken out,
give each its purity if it is too frequent among toxic rows for chance, and a document's score joins the words found as
independent causes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, slices, table

#: The bound of the labelled sample that the evidence is weighed by.
TRAIN_ROWS = 20_000
#: The least number of toxic rows that show a piece of evidence, its least purity, and the odds of chance that it must be below.
SUPPORT, PURE, CHANCE = 8, 0.8, 2e-7
THRESHOLD = 0.3
#: The score of a text without evidence.
BASE = 0.01
#: Marks by which near copies are taken out of the sample.
MARKS, PRIME = 3, (1 << 61) - 1
BEGINNINGS = range(4, 8)
#: Signs and the letters they can stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e"}
SEPARATORS = frozenset(" ._-*~·/\\,'`^=#&%:;?()[]{}<>\"")
START = "".join(SEPARATORS) + "…«»“”„¡¿"
EDGE = "".join(SEPARATORS) + "!$|+…«»“”„¡¿"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIGN, SAME, AGAIN, GAP = math.log(0.05), 0.0, math.log(0.3), math.log(0.05)
#: Single signs with any white space between them; lines of one sign each are such a run too.
SPACED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
#: What stands between two of the signs that join tokens, and letters or look-alike signs spelt out between them.
JOINED = re.compile(r"[^\s._*~·/\\,'`^=#&%:;?()\[\]{}<>\"-]+")
SPELT = re.compile(r"(?<![^._/-])[^\s._/-](?:[._/-]{1,2}[^\s._/-]){2,}(?![^._/-])")
PARTS = re.compile(r"[^\W\d_]+")
REMEMBERED, REMEMBERED_LENGTH = 50_000, 200
#: Letters of a run without word edges that are looked at from each of its letters on.
LONG = 40


@dataclass
class LetterModel:
    """Interpolated trigrams of letters between word edges."""

    counts: dict[str, int]
    context: Counter = field(default_factory=Counter)
    pair: Counter = field(default_factory=Counter)
    single: Counter = field(default_factory=Counter)
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for gram, n in self.counts.items():
            self.context[gram[:2]] += n
            self.pair[gram[1:]] += n
            self.single[gram[2]] += n
        self.before = Counter()
        for gram, n in self.pair.items():
            self.before[gram[0]] += n
        self.total = sum(self.single.values())

    def log(self, gram: str) -> float:
        found = self.known.get(gram)
        if found is None:
            one = (self.single[gram[2]] + 1) / (self.total + 64)
            two = (self.pair[gram[1:]] + 4 * one) / (self.before[gram[1]] + 4)
            three = (self.counts.get(gram, 0) + 4 * two) / (self.context[gram[:2]] + 4)
            found = self.known[gram] = math.log(three)
        return found


def readings(sign: str) -> Iterator[tuple[str, float]]:
    """Letters that one sign can stand for, "" for a gap, with the channel's log probability."""
    if sign in LOOKS_LIKE:
        for letter in LOOKS_LIKE[sign]:
            yield letter, SIGN
        if not sign.isdigit():
            yield "", SIGN + GAP
    elif sign.isalpha():
        yield sign, SAME
    else:
        yield "", GAP


def restore(token: str, model: LetterModel) -> str:
    """The likeliest letters behind a token: a Viterbi pass over states of the last two letters.

    Letters that all paths share are written out as soon as one state is left, so time and memory are linear.
    """
    done: list[str] = []
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # a path is (path before, letter)
    for k, sign in enumerate(token):
        again = sign * 3 in token[max(0, k - 2) : k + 3]  # in a run of three or more
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, made) in best.items():
            for letter, cost in readings(sign):
                steps = [(state, score + cost, made)] if not letter else [(state[1] + letter, score + cost + model.log(state + letter), (made, letter))]
                if again and letter and letter == state[1]:  # the same letter written again
                    steps.append((state, score + cost + AGAIN, made))
                for to, s, path in steps:
                    if to not in after or s > after[to][0]:
                        after[to] = s, path
        best = after or best
        if len(best) == 1:
            ((state, (score, path)),) = best.items()
            done += _spelt(path)
            best = {state: (score, None)}
    _, last = max((s + model.log(state + "$"), "".join(_spelt(path))) for state, (s, path) in best.items())
    return "".join(done) + last


def _spelt(path: tuple | None) -> list[str]:
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return out[::-1]


def letter_counts(docs: DataFrame) -> dict[str, int]:
    """Trigrams of all plain words of all texts; there are at most as many as triples of the alphabet's signs."""
    alphabet = frozenset(LETTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    words.update(text.lower().split())
            grams: Counter[str] = Counter()
            for word, n in words.items():
                word = word.strip(EDGE)
                if word.isalpha() and alphabet.issuperset(word):
                    word = f"^^{word}$"
                    for k in range(len(word) - 2):
                        grams[word[k : k + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array([*grams], pa.string()), pa.array([*grams.values()], pa.int64())], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: r.n for r in rows}


class Reader:
    """Restored words of a text: plain ones as they are, marked ones decoded and remembered."""

    def __init__(self, model: LetterModel) -> None:
        self.model, self.known = model, {}

    def _decoded(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            core = token.lstrip(START).rstrip(EDGE)
            if core.isalpha() and not any(c * 3 in core for c in set(core)):
                found = (core,)
            elif not any(c.isalpha() for c in core):
                found = tuple(PARTS.findall(core))
            else:
                pieces = dict.fromkeys([core, *PARTS.findall(core), *JOINED.findall(core)])
                spelt = (w for m in SPELT.finditer(core) for w in endings(restore(m[0], self.model)))
                found = tuple(dict.fromkeys([*(restore(p, self.model) for p in pieces), *spelt]))
            if len(token) > REMEMBERED_LENGTH:
                return found
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def words(self, text: str, heads: frozenset[str] | None = None) -> set[str]:
        """Restored words; if heads are given, only those with such first letters are sought among plain words."""
        low = text.lower()
        out: set[str] = set()
        tripled = [c * 3 for c in LETTERS if c * 3 in low]
        for token in set(low.split()):
            if token.isalpha() and not (tripled and any(t in token for t in tripled)):
                if heads is None or token[:3] in heads:
                    out.add(token)
            elif len(token) > 1:
                out.update(self._decoded(token))
        for m in SPACED.finditer(low):
            out.update(w for w in endings(restore(m[0], self.model)) if heads is None or w[:3] in heads)
        return out


def endings(word: str) -> Iterator[str]:
    """What letters without word edges can hold: all from each letter on, cut after LONG letters, and the whole."""
    yield word
    for k in range(max(1, len(word) - 3)):
        yield word[k : k + LONG]


def evidence_of(words: Iterable[str]) -> set[str]:
    """A word's beginnings, and the whole of it with an edge."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w + "$")
            out.update(w[:k] for k in BEGINNINGS if k <= len(w))
    return out


@dataclass(frozen=True)
class ToxicityModel:
    counts: dict[str, int]
    evidence: dict[str, float]
    base: float

    def score(self, words: set[str]) -> float:
        """Words speak independently; of a word's own pieces of evidence the strongest does."""
        clean, own = 1 - self.base, self.evidence
        for w in words:
            if pieces := [own[e] for e in evidence_of((w,)) if e in own]:
                clean *= 1 - max(pieces)
        return 1 - clean


def chance(n: int, toxic: int, rate: float) -> float:
    """Log of a bound on the odds that so many of n rows are toxic if each is at the overall rate (Chernoff)."""
    share = toxic / n
    if share <= rate:
        return 0.0
    rest = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return -n * (share * math.log(share / rate) + rest)


def weigh(found: list[tuple[str, int, int]], rows: int, toxic: int) -> dict[str, float]:
    """Smoothed purity of each (evidence, rows, toxic rows) that is pure and too frequent among toxic rows for chance.

    A beginning must be pure without its most frequent continuation too, else it is that which speaks.
    """
    if not rows or not toxic:
        return {}
    rate = (toxic + 1) / (rows + 10)
    limit = math.log(CHANCE)
    purity = lambda n, t: (t + 2 * rate) / (n + 2)
    found = sorted(found)
    out = {}
    for k, (e, n, t) in enumerate(found):
        if t >= SUPPORT and chance(n, t, rate) < limit and purity(n, t) >= PURE:
            longer = takewhile(lambda x: x[0].startswith(e), (found[j] for j in range(k + 1, len(found))))  # noqa: B023
            _, n_x, t_x = max(longer, key=lambda x: x[2], default=(e, 0, 0))
            if n - n_x < 3 or purity(n - n_x, t - t_x) >= PURE / 2:
                out[e] = purity(n, t)
    return out


def learnable(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels may be learnt from; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def least_shingles(text: str, size: int = 5) -> list[int]:
    """The least hashes of a text's five-word shingles by MARKS functions, which near copies most likely share."""
    words = text.lower().split()
    shingles = {" ".join(words[k : k + size]).encode() for k in range(max(1, len(words) - size + 1))}
    hashes = [zlib.crc32(s) for s in shingles]
    return [min((h * a + a) % PRIME for h in hashes) for a in (2_654_435_761, 1_597_334_677, 3_812_015_801)[:MARKS]]


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Count letters over all docs, and weigh evidence by labelled rows that may be learnt from.

    labels has doc_id and toxic; null labels are left out; of repeated labels of a row the largest counts. Without
    labelled toxic rows there is no evidence and every score is BASE.
    """
    counts = letter_counts(docs)
    known = labels.filter(learnable() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # the sample is bounded, so its ids may be sent to the tasks
    sample = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    sample = _without_copies(cut(sample))
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    often = _evidence_counts(sample.filter("toxic = 1"), counts).filter(F.col("n") >= SUPPORT)
    # of a sample of so many rows; each piece is in SUPPORT of them at least
    wanted = frozenset(r.e for r in often.select("e").collect())
    found = _evidence_counts(sample, counts, wanted).filter("2 * t >= n").collect() if wanted else []
    return ToxicityModel(counts, weigh([(r.e, r.n, r.t) for r in found], rows, toxic), BASE)


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sample without repeated rows and near copies, which would count one text's words again and again."""
    names = [f"mark{k}" for k in range(MARKS)]

    def mark(batch: pa.RecordBatch) -> dict[str, object]:
        marks = [least_shingles(t) for t in batch.column("text").to_pylist()]
        return {n: [m[k] for m in marks] for k, n in enumerate(names)}

    sample = sample.withColumn("_dw_text", F.xxhash64("text"))
    kept = arrow_map(sample, mark, ", ".join(f"{n} long" for n in names), ["doc_id", "toxic", "_dw_text"])
    chance = F.struct(F.xxhash64("doc_id"), F.col("doc_id"), F.col("_dw_text"))  # the same row of a group in every run
    for group in (["doc_id"], *(["toxic", n] for n in names)):
        kept = kept.groupBy(*group).agg(F.min_by(F.struct("doc_id", "toxic", "_dw_text", *names), chance).alias("r")).select("r.*")
    kept = F.broadcast(cut(kept.select("doc_id", "_dw_text")))  # a bounded sample's
    return cut(sample.join(kept, ["doc_id", "_dw_text"]).drop("_dw_text").dropDuplicates(["doc_id"]))


def _evidence_counts(sample: DataFrame, counts: dict[str, int], wanted: frozenset[str] | None = None) -> DataFrame:
    """(e, n, t): rows and toxic rows with each piece of evidence (each wanted one, if given); tasks add up their own first."""
    sent = sample.sparkSession.sparkContext.broadcast((counts, wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, only = sent.value
        reader = Reader(LetterModel(letters))
        for batch in slices(batches, 256):
            n: Counter[str] = Counter()
            t: Counter[str] = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = evidence_of(reader.words(text))
                own = own if only is None else own & only
                n.update(own)
                if toxic:
                    t.update(own)
            yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64()), pa.array([t[e] for e in n], pa.int64())], names=["e", "n", "t"])

    return sample.select("text", "toxic").mapInArrow(count, "e string, n long, t long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if not said) with _dw_score; null and empty texts have the base score.

    Every row is scored by its whole text, however long, so rows with equal texts score alike, and repeated rows stay. Other
    columns, score among them, stay as they are; an empty table gives no rows.
    """
    keep = list(docs.columns if keep is None else keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch) -> dict[str, object]:
        own = sent.value
        if not hasattr(own, "reader"):
            object.__setattr__(own, "reader", Reader(LetterModel(own.counts)))
            object.__setattr__(own, "heads", frozenset(e[:3] for e in own.evidence))
        return {"_dw_score": [own.score(own.reader.words(t, own.heads)) if t else own.base for t in batch.column("text").to_pylist()]}

    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), add, "_dw_score double", keep)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity by a model of the labels that aren't held out. A null doc_id is held out: nothing is learnt from it."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, model, ["doc_id"])
    return found.select("doc_id", (~F.coalesce(learnable(), F.lit(False))).alias("held_out"), F.col("_dw_score").alias("score"), (F.col("_dw_score") >= THRESHOLD).cast("int").alias("predicted"))
