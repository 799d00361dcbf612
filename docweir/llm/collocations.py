"""Phrase collocations by hierarchical pair naming.

Frequent words get ids. A text is then the row of its words' ids, and level by level each pair of adjacent, overlapping
frequent (k-1)-grams that is frequent itself gets an id, by which the pair's places are replaced: the id of the k-gram
that begins there. A name keeps its pair, so its two halves' names are parent pointers: along them come the counts of
all first parts and rests for the cuts, and a gram that stands in a longer one is a parent of one that is one word longer.

Texts are turned into blocks of local numbers, with a table of what each number stands for; only these tables, one row
for each thing and block, are shuffled and joined, so a frequent word has as many rows as there are blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, cut, slices, table

LONGEST, LEAST, BEST = 3, 10, 2000
#: A gram goes if a longer one that holds it has at least SHARE hundredths of its count.
SHARE = 50
SCALE = 1_000_000
#: Words, or distinct words, at which a block is closed.
BLOCK_WORDS, BLOCK_NAMES = 2_000_000, 300_000
#: What ends a piece becomes one sign, which no word holds.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"..........")
_CODEC = pa.Codec("zstd")


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased; a full stop stands wherever a piece ends."""
    return text.lower().translate(_ENDS).replace(b".", b" . ").split()


def _squeezed(x: np.ndarray) -> bytes:
    """The size in bytes, then the numbers compressed."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def _unsqueezed(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(_CODEC.decompress(data[8:], size, asbytes=True) if size else b"", kind)


class _Numbers(dict):
    """Numbers from 1 on for the words of each language; a missing one gets the next."""

    def __init__(self, words: list[tuple[str, bytes]], lang: str) -> None:
        super().__init__({b".": 0})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = number = len(self.words)
        return number


VOCABULARY = "block long, code int, lang string, word string, n long, seq binary"
PAIRS = "block long, left long, right long, n long, seq binary, ids binary"


def _numbered(docs: DataFrame) -> DataFrame:
    """Of each block: a row for every distinct (lang, word) with its number and count, and a row with the texts in numbers, 0 where a piece ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        words, numbers, seqs, n = [], {}, [], 0
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = words_of(text)
                if lang not in numbers:
                    numbers[lang] = _Numbers(words, lang)
                seqs.append(np.fromiter(map(numbers[lang].__getitem__, own), np.int32, len(own)))
                seqs.append(np.zeros(1, np.int32))
                n += len(own)
                if n >= BLOCK_WORDS or len(words) >= BLOCK_NAMES:
                    yield from _vocabulary(part << 32 | at, words, seqs)
                    words, numbers, seqs, n, at = [], {}, [], 0, at + 1
        if seqs:
            yield from _vocabulary(part << 32 | at, words, seqs)

    return cut(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, VOCABULARY))


def _vocabulary(block: int, words: list[tuple[str, bytes]], seqs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    seq, size = np.concatenate(seqs), len(words)
    counts = np.bincount(seq, minlength=size + 1)[1:]
    null = lambda kind: pa.nulls(1, kind)
    columns = [
        pa.array(np.full(size + 1, block)),
        pa.concat_arrays([null(pa.int32()), pa.array(np.arange(1, size + 1, dtype=np.int32))]),
        pa.concat_arrays([null(pa.string()), pa.array([x for x, _ in words], pa.string())]),
        pa.concat_arrays([null(pa.string()), pa.array([w for _, w in words], pa.binary()).cast(pa.string())]),
        pa.concat_arrays([null(pa.int64()), pa.array(counts, pa.int64())]),
        pa.concat_arrays([pa.array([_squeezed(seq)], pa.binary()), pa.nulls(size, pa.binary())]),
    ]
    whole = pa.RecordBatch.from_arrays(columns, names=["block", "code", "lang", "word", "n", "seq"])
    yield from (whole.slice(k, 8_192) for k in range(0, whole.num_rows, 8_192))


def _named(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """rows (key, n, ...) of keys whose n add up to least, with the sum a and one id for each key; first marks one row of each."""
    same = W.partitionBy(*key)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    met = numbered.withColumn("a", F.sum("n").over(same)).withColumn("id", F.min("_row").over(same))
    return cut(met.filter(F.col("a") >= least).withColumn("first", F.col("_row") == F.col("id")).drop("_row", "n"))


def _adjacent(block: int, seq: np.ndarray, ids: np.ndarray, keep: bool) -> Iterator[pa.RecordBatch]:
    """A block's row of local numbers, if it is needed again, and its distinct adjacent pairs with their counts."""
    both = (seq[:-1] > 0) & (seq[1:] > 0)
    pair, n = np.unique(seq[:-1][both].astype(np.int64) * (len(ids) + 1) + seq[1:][both], return_counts=True)
    left, right = ids[pair // (len(ids) + 1) - 1], ids[pair % (len(ids) + 1) - 1]
    null, size = pa.nulls(1, pa.int64()), len(pair)
    longs = [pa.concat_arrays([null, pa.array(x, pa.int64())]) for x in (left, right, n)]
    held = [pa.concat_arrays([pa.array([x if keep else None], pa.binary()), pa.nulls(size, pa.binary())]) for x in (_squeezed(seq), _squeezed(ids))]
    whole = pa.RecordBatch.from_arrays([pa.array(np.full(size + 1, block)), *longs, *held], names=["block", "left", "right", "n", "seq", "ids"])
    yield from (whole.slice(k, 8_192) for k in range(0, whole.num_rows, 8_192))


def _field(row: pa.RecordBatch, name: str) -> np.ndarray:
    return row.column("found").flatten().field(name).to_numpy(zero_copy_only=False)


def _replaced(rows: DataFrame, named: DataFrame, first: bool, keep: bool) -> DataFrame:
    """The blocks with the numbers of what has a name now, and their pairs: of words (first) or of pairs of the level before."""
    fields = ["code", "id"] if first else ["left", "right", "id"]
    found = named.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("found"))  # a block's own names
    held = rows.filter("seq is not null").select("block", "seq", *([] if first else ["ids"])).join(found, "block")

    def words(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        seq, code = _unsqueezed(row.column("seq")[0].as_py(), np.int32), _field(row, "code")
        number = np.zeros(max(int(seq.max(initial=0)), int(code.max())) + 1, np.int32)
        number[code] = np.arange(1, len(code) + 1)
        return number[seq], _field(row, "id").astype(np.int64)

    def pairs(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        seq, ids = _unsqueezed(row.column("seq")[0].as_py(), np.int32), _unsqueezed(row.column("ids")[0].as_py(), np.int64)
        order = np.argsort(ids)
        local = lambda x: order[np.searchsorted(ids[order], x)].astype(np.int64) + 1
        key = local(_field(row, "left")) * (len(ids) + 1) + local(_field(row, "right"))
        by = np.argsort(key)
        key, new = key[by], _field(row, "id").astype(np.int64)[by]
        at = seq[:-1].astype(np.int64) * (len(ids) + 1) + seq[1:]
        at[(seq[:-1] == 0) | (seq[1:] == 0)] = -1
        place = np.minimum(np.searchsorted(key, at), len(key) - 1)
        return np.append(np.where(key[place] == at, place + 1, 0), 0).astype(np.int32), new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            yield from _adjacent(row.column("block")[0].as_py(), *(words if first else pairs)(row), keep)

    return cut(held.mapInArrow(run, PAIRS))


def grams(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """The names of each level, and (lang, n): all occurrences of words in a language.

    A name is (id, lang, phrase, last, a, heads, tails, left, right): its words, the last of them, its count, the counts of
    its first 1, 2 ... words and of the rests after them, and the names of what it is without its last or first word.
    """
    bound_batches(docs.sparkSession)
    rows = _numbered(docs)
    sizes = rows.filter("word is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    named = _named(rows.filter("word is not null").select("block", "code", "lang", "word", "n"), ["lang", "word"], least)
    none = F.array().cast("array<long>")
    names = [named.filter("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"), *(F.lit(None).cast("long").alias(c) for c in ("left", "right")))]
    for size in range(2, longest + 1):
        rows = _replaced(rows, named, size == 2, size < longest)
        pairs = rows.filter("left is not null").select("block", "left", "right", "n")
        if size < longest:
            named = _named(pairs, ["left", "right"], least)
            fresh = named.filter("first").select("id", "left", "right", "a")
        else:  # nothing is made of the last level's places
            counted = pairs.groupBy("left", "right").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
            fresh = cut(counted.withColumn("id", F.monotonically_increasing_id()))
        head = names[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_phrase"), F.concat("heads", F.array("a")).alias("heads"))
        tail = names[-1].select(F.col("id").alias("right"), "last", F.concat(F.array("a"), "tails").alias("tails"))
        met = fresh.join(head, "left").join(tail, "right").withColumn("phrase", F.concat_ws(" ", "_phrase", "last"))
        names.append(cut(met.select("id", "lang", "phrase", "last", "a", "heads", "tails", "left", "right")))
    return names, sizes


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int | None = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to longest words by score, the first best of them (all if None).

    docs has text and lang; a null lang is und, a null text empty. Only phrases that occur least times count; of a
    phrase's cuts the lowest score counts, of equal ones the first. A phrase goes if a longer one that holds it has SHARE
    hundredths of its count. Equal scores stand by count, then by phrase in byte order. Rows count as often as they are
    there, texts of any length are read whole, other columns are not read, and an empty table gives an empty one.
    """
    names, sizes = grams(docs, longest, least)
    kept = []
    for k in range(1, longest):
        own = names[k]
        if k + 1 < longest:
            longer = names[k + 1].select("left", "right", F.col("a").alias("more"))
            parents = longer.select(F.col("left").alias("id"), "more").unionByName(longer.select(F.col("right").alias("id"), "more"))
            own = own.join(parents.groupBy("id").agg(F.max("more").alias("more")), "id", "left")
            own = own.filter(F.col("more").isNull() | (100 * F.col("more") < SHARE * F.col("a")))
        kept.append(own.select("lang", "phrase", "a", "heads", "tails"))
    found = kept[0]
    for other in kept[1:]:
        found = found.unionByName(other)
    # decimals of 38 digits hold the products exactly; a quotient is at most SCALE
    cuts = F.expr(
        f"transform(heads, (l, k) -> struct((cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(tails[k] as decimal(20,0))) as score, k, l, tails[k] as r))"
    )
    scored = found.select("lang", "phrase", "a", F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank)
    first = ranked if best is None else ranked.filter(F.col("rank") <= best)
    return first.join(F.broadcast(sizes) if best is not None else sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's two thousand strongest phrases of two and three words."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def brute_force(rows: list[tuple[str | None, str | None]], longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> list[tuple]:
    """What op13 returns of (lang, text), by counting every phrase of every piece; for tests."""
    import re

    count: Counter = Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    count["und" if lang is None else lang, tuple(words[k : k + size])] += 1
    size: Counter = Counter()
    for (lang, words), n in count.items():
        if len(words) == 1:
            size[lang] += n
    found = {}
    frequent = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in frequent.items():
        inside = lambda x, w=w: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
        if any(g == lang and len(x) > len(w) and 100 * m >= SHARE * a and inside(x) for (g, x), m in frequent.items()):
            continue
        score, _, left, right = min((SCALE * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, left, right, score))
    return [
        (lang, n + 1, p.decode(), a, left, right, size[lang], score)
        for lang, own in sorted(found.items())
        for n, (_, _, p, a, left, right, score) in enumerate(sorted(own)[:best])
    ]


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SCORE = f"CAST({SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT)"
ORACLE = rf"""
WITH p AS (SELECT lang, row_number() OVER () AS pid, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
 u AS (SELECT lang, pid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
 t AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER q AS w2, lead(w1, 2) OVER q AS w3 FROM u WINDOW q AS (PARTITION BY pid ORDER BY i)),
 f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS a FROM t GROUP BY ALL),
 f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS a FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
 f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS a FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
 c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, x.a AS l, y.a AS r, 1 AS k FROM f2 JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  ANTI JOIN (SELECT lang, w1, w2, max(a) AS more FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL) i ON i.lang = f2.lang AND i.w1 = f2.w1 AND i.w2 = f2.w2 AND 100 * more >= {SHARE} * f2.a),
 c3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.a, x.a AS l, y.a AS r, 1 AS k FROM f3 JOIN f1 x USING (lang, w1) JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, x.a, y.a, 2 FROM f3 JOIN f2 x USING (lang, w1, w2) JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
 low AS (SELECT *, {_SCORE} AS score FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low JOIN n USING (lang) QUALIFY rank <= {BEST}
"""
