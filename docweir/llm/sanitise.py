"""Personal data: patterns for what identifies by itself, and corpus co-occurrence for terms that give it away.

The patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value found is a protected
entity. How much a term t reveals of an entity e is the share of e's information that t carries,
pmi(e; t) / -log2 p(e), with p estimated over distinct contexts: a context is the CONTEXT words on either side of an
entity's mention, and elsewhere of the term. p(t) counts both over every text of the corpus, so copies count once on
either side. A term that carries at least DISCLOSURE of the information and was seen with e in SUPPORT distinct
contexts or more is hidden wherever it occurs.

Terms are counted in one pass however many there are: tasks hold a map of bits of fixed size that says which words may
be candidates, and a join on the word decides.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Collection, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, slices, table

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 8
SUPPORT = 3
DISCLOSURE = 0.95
#: Disclosing terms up to which all tasks hold them; more meet the texts in a join.
HELD_TERMS = 200_000
#: Bits of the map of words that may be terms; words that share a bit are told apart by a join.
MAP_BITS = 1 << 24
SPANS = "_dw_spans array<struct<start:long,end:long,kind:string>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# runs of digits are tried from their first digit only: where that fails, no later digit of the run matches
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest local part before each @ that has a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    """(start, end, kind) in code points, by start and then kind."""
    if not text:
        return []
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    digits = re.compile(r"[^0-9]+").sub
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def entity(text: str, span: Span) -> str:
    """One form of a value, however it is written."""
    start, end, kind = span
    value = text[start:end]
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]+', '', value)}"


def _telling(words: list[str]) -> list[str]:
    """The distinct words, sorted, that can be terms."""
    return sorted({w.lower() for w in words if len(w) > 2 and not w.isdigit()})


class Words:
    """The words of a text that touch no mention, and those around each mention."""

    def __init__(self, text: str, spans: list[Span]) -> None:
        self.text, edges, k, far = text, sorted((a, b) for a, b, _ in spans), 0, -1
        self.starts: list[int] = []
        self.ends: list[int] = []
        for m in WORD.finditer(text):
            while k < len(edges) and edges[k][0] < m.end():
                far, k = max(far, edges[k][1]), k + 1
            if m.start() >= far:
                self.starts.append(m.start())
                self.ends.append(m.end())

    def around(self, span: Span) -> tuple[int, int]:
        """Numbers of the first word around a mention and of the one after the last."""
        before, after = bisect_right(self.ends, span[0]), bisect_left(self.starts, span[1])
        return max(0, before - CONTEXT), min(len(self.starts), after + CONTEXT)

    def some(self, a: int, b: int) -> list[str]:
        return [self.text[self.starts[k] : self.ends[k]] for k in range(max(0, a), min(len(self.starts), b))]


def contexts(text: str, spans: list[Span]) -> Iterator[tuple[str, list[str]]]:
    """Each mention's entity and the distinct words around it that are no part of a mention, however far they are."""
    words = Words(text, spans)
    for span in spans:
        yield entity(text, span), _telling(words.some(*words.around(span)))


def _digest(words: list[str]) -> str:
    return hashlib.md5(" ".join(words).encode()).hexdigest()[:16]


def _mentions(docs: DataFrame) -> DataFrame:
    """(entity, term, context): the terms of each distinct context of each entity; contexts repeated by copies are one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[tuple[str, str], list[str]] = {}
            for text in batch.column("text").to_pylist():
                if spans := base_spans(text):
                    for who, words in contexts(text, spans):
                        rows[who, _digest(words)] = words
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array([*rows.values()], pa.list_(pa.string()))],
                names=["entity", "context", "terms"],
            )

    return docs.select("text").mapInArrow(find, "entity string, context string, terms array<string>")


def elsewhere(text: str, bits: BitMap) -> Iterator[tuple[str, str]]:
    """Each occurrence of a wanted term outside all mentions and their contexts, with the digest of the words around it."""
    wanted = bits.among(set(map(str.lower, WORD.findall(text))))
    if not wanted:
        return
    spans = base_spans(text)
    words = Words(text, spans)
    near, far = sorted(map(words.around, spans)), 0
    near.append((len(words.starts), len(words.starts)))
    for a, b in near:
        for k in range(far, a):
            if (term := words.some(k, k + 1)[0].lower()) in wanted:
                yield term, _digest(_telling(words.some(k - CONTEXT, k + CONTEXT + 1)))
        far = max(far, b)


class BitMap:
    """Which words have their bits set; remembers some that don't."""

    def __init__(self, bits: bytes) -> None:
        self.bits, self.unset = bits, set()

    def among(self, words: set[str]) -> set[str]:
        fresh, n = words - self.unset, 8 * len(self.bits)
        found = {w for w in fresh if self.bits[(at := zlib.crc32(w.encode()) % n) >> 3] >> (at & 7) & 1}
        if len(self.unset) > 200_000:
            self.unset = set()
        self.unset |= fresh - found
        return found


def bit_map(terms: DataFrame, size: int = MAP_BITS) -> bytes:
    """Bits of all terms: size / 8 bytes, whatever the number of terms."""
    place = F.crc32(F.col("term").cast("binary")) % F.lit(size)
    # a row for each 64 bits at most
    rows = terms.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


def _elsewhere_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_out): distinct contexts, outside those of mentions, of the terms, and of words that share a bit with one."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = BitMap(sent.value)
        for batch in slices(batches):
            rows = {x for text in batch.column("text").to_pylist() if text for x in elsewhere(text, wanted)}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in (0, 1)], names=["term", "around"])

    rows = docs.select("text").mapInArrow(count, "term string, around string").distinct()
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n_out"))


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term): terms that carry at least the given share of a protected entity's information, in the shared folder.

    What is joined is written down first, so that Spark can split the rows of an entity or a term that most pages have.
    """
    found = cut(_mentions(docs).dropDuplicates(["entity", "context"]))
    total = found.count()
    seen = cut(found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support))
    each = found.select("entity", F.explode("terms").alias("term"))
    joint = cut(each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support))
    inside = cut(each.groupBy("term").agg(F.count(F.lit(1)).alias("n_in")).filter(F.col("n_in") >= support))
    # p(e|t) over all distinct contexts of t, held against p(e) over all contexts of mentions
    share = lambda n: 1 + F.log2(F.least(F.lit(1.0), F.col("n_et") / n)) / -F.log2(F.col("n_e") / F.lit(total + 1.0))
    # what fails by the contexts of mentions alone fails by all
    joint = cut(joint.join(seen, "entity").join(inside, "term").filter(share(F.col("n_in")) >= disclosure))
    if joint.isEmpty():
        return joint.select("term")
    outside = cut(_elsewhere_counts(docs, joint))
    joint = joint.join(outside, "term", "left").fillna(0, ["n_out"])
    return cut(joint.filter(share(F.col("n_in") + F.col("n_out")) >= disclosure).select("term").distinct())


def _with_terms(text: str, spans: list[Span], wanted: Callable[[str], bool]) -> list[Span]:
    own = [(m.start(), m.end(), "term") for m in WORD.finditer(text) if wanted(m[0].lower())]
    starts, ends = [s[0] for s in sorted(spans)], [*accumulate((s[1] for s in sorted(spans)), max)]
    # of the spans that begin before a term's end, one reaches into it if the farthest does
    free = [s for s in own if not (k := bisect_left(starts, s[1])) or ends[k - 1] <= s[0]]
    return sorted([*spans, *free], key=lambda x: (x[0], KINDS.index(x[2])))


def find_personal(docs: DataFrame, terms: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if not said) with _dw_spans, by start and kind, in code points, end exclusive.

    terms, one column of them, are hidden besides the patterns; if not given, disclosing_terms() of docs. Null and empty
    texts have no spans; each row is judged by itself, however long; repeated rows alike.
    """
    keep = list(docs.columns if keep is None else keep)
    return _with_spans(docs, terms, lambda text, spans: [{"start": a, "end": b, "kind": c} for a, b, c in spans], SPANS, keep)


def _with_spans(docs: DataFrame, terms: DataFrame | None, made: Callable[[str | None, list[Span]], object], added: str, keep: list[str]) -> DataFrame:
    """The kept columns with one more, made of each text and its spans by the worker that finds them: a second function in
    the task would take a second worker, whose memory outlives it."""
    columns = [*dict.fromkeys([*keep, "text"])]
    name = added.split()[0]
    out = [*(c for c in keep if c != name), name]
    terms = (disclosing_terms(docs) if terms is None else terms).toDF("term")
    few = [r.term for r in terms.limit(HELD_TERMS + 1).collect()]
    if len(few) > HELD_TERMS:
        return _made_by_join(docs.select(*columns), terms, made, added).select(*out)
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(few))

    def find(batch: pa.RecordBatch) -> dict[str, object]:
        return {name: [made(text, _spans_of(text, sent.value)) for text in batch.column("text").to_pylist()]}

    return arrow_map(docs.select(*columns), find, added, columns).select(*out)


def _spans_of(text: str | None, wanted: Collection[str]) -> list[Span]:
    spans = base_spans(text)
    return _with_terms(text, spans, wanted.__contains__) if text and wanted else spans


def _made_by_join(docs: DataFrame, terms: DataFrame, made: Callable[[str | None, list[Span]], object], added: str) -> DataFrame:
    """_with_spans() where the terms are too many for a task: each distinct text meets its own terms by its digest."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(terms))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = BitMap(sent.value)
        for batch in slices(batches):
            texts = dict(zip(batch.column("_dw_of").to_pylist(), batch.column("text").to_pylist(), strict=True))
            rows = [(k, w) for k, t in texts.items() if t for w in wanted.among(set(map(str.lower, WORD.findall(t))))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["_dw_of", "term"])

    keyed = docs.withColumn("_dw_of", F.sha2(F.col("text").cast("binary"), 256))
    may = cut(keyed.select("_dw_of", "text").mapInArrow(pick, "_dw_of string, term string").distinct())
    own = may.join(cut(terms.distinct()), "term").groupBy("_dw_of").agg(F.collect_list("term").alias("_dw_terms"))  # a text's own words

    def find(batch: pa.RecordBatch) -> dict[str, object]:
        columns = batch.column("text").to_pylist(), batch.column("_dw_terms").to_pylist()
        return {added.split()[0]: [made(text, _spans_of(text, frozenset(own or ()))) for text, own in zip(*columns, strict=True)]}

    met = keyed.join(cut(own), "_dw_of", "left").select(*docs.columns, "_dw_terms")
    return arrow_map(met, find, added, docs.columns)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind; what remains holds no base span."""
    out, at = [], 0
    stretch: list = []
    for a, b, kind in [*sorted(spans), (len(text) + 1, len(text) + 1, "")]:
        if stretch and a > stretch[1] - 1:
            out += [text[at : stretch[0]], f"[{stretch[2].upper()}]"]
            at, stretch = stretch[1], []
        if stretch:
            stretch[1] = max(stretch[1], b)
        else:
            stretch = [a, b, kind]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """docs with personal data and disclosing terms replaced in text, and n_chars (if there) counted anew."""

    def replaced(text: str | None, spans: list[Span]) -> str | None:
        while text and spans:
            text = redact(text, spans)
            spans = base_spans(text)
        return text

    made = _with_spans(docs, terms, replaced, "text string", docs.columns)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return made.select(*docs.columns)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts by kind, the digest of its pattern spans, and all its spans."""
    found = find_personal(table(spark, sf_dir, "documents"), keep=["doc_id"])
    of_kind = lambda k: F.size(F.filter("_dw_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(_joined(F.filter("_dw_spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
        _joined(F.col("_dw_spans")).alias("spans"),
        of_kind("term").alias("n_term"),
    )


def brute_force(text: str | None) -> list[Span]:
    """base_spans() by the patterns as they are stated; for tests."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    out = [(m.start(), m.end(), k) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))
