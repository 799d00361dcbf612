"""Substring deduplication by difference-cover anchors.

The cover holds five residues modulo 21 such that any two places of a text, and so any two occurrences of a window, have a
shift under 21 that takes both to places of the cover. Only the 30-word runs that begin at such places are hashed: two
equal windows of 50 words hold one of them at the same distance from their start, an aligned anchor. Anchors that stand
in several documents are then extended. Those that follow each other on one diagonal of the document where they stand
first prove all windows between them; the windows around the others are compared by hashes of 128 bits.

Documents travel in blocks of some megabytes, written once into buckets by block, so that what is found out about a
block comes back to it and its texts don't move. Anchors and windows are made distinct within a block before they are
shuffled, so no key has more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, drop_table, scratch, shared_dir, short_shuffles, slices, table, write_table

WINDOW, PERIOD = 50, 21
#: Differences of these residues give every residue modulo PERIOD.
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text, and rows, at which a block is closed.
BLOCK_BYTES, BLOCK_ROWS = 2_000_000, 4_096
#: What a null doc_id counts as: it stands behind all others.
LAST = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def run_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many codes: hashes of 1, 2, 4 ... codes are made from each other and those that add up to size joined."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, width, run = np.full(n, size, np.uint64), 0, 1, codes
    while True:
        if size & width:
            out = _mixed(out * _ODD[1] + run[at : at + n])
            at += width
        if at == size:
            return out
        run = _mixed(run[:-width] * _ODD[1] + run[width:])
        width *= 2


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text: what isn't blank or one of the five controls from tab to carriage return."""
    return text.split() if text else []


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans [start, end)."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    change -= np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


class Block:
    """The documents of one block: their words in a row, each document's place, and hashes of runs of words."""

    def __init__(self, batch: pa.RecordBatch, id_column: str, text_column: str) -> None:
        self.batch = batch
        texts = batch.column(text_column).cast(pa.binary()).to_pylist()
        held = [words_of(t) for t in texts]
        self.lengths = np.array([len(w) for w in held], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = [w for own in held for w in own]
        ids = batch.column(id_column).cast(pa.int64())
        self.ids = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        coded = pa.array(self.words, pa.binary()).dictionary_encode()
        digests = [xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()]
        lanes = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        code = coded.indices.to_numpy()
        self.lanes = [lanes[code, k] for k in (0, 1)]
        self.doc = np.repeat(np.arange(len(held)), self.lengths)
        self.place = np.arange(len(self.words)) - self.begins[self.doc]
        left = self.lengths[self.doc] - self.place
        self.starts = left >= WINDOW  # where a window begins
        self.at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (left >= ANCHOR) & (self.lengths[self.doc] >= WINDOW))

    def anchors(self) -> np.ndarray:
        """The hash of the anchor at each place of self.at."""
        return run_hashes(self.lanes[0], ANCHOR)[self.at].view(np.int64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the hash of the window at each of these places."""
        return tuple(run_hashes(lane, WINDOW)[at].view(np.int64) for lane in self.lanes)


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    sink, rows = pa.BufferOutputStream(), pa.Table.from_batches(batches).combine_chunks()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_all().combine_chunks().to_batches()[0]


def _blocks(docs: DataFrame, text_column: str) -> tuple[DataFrame, str]:
    """(block, rows): the documents in blocks, as Arrow streams, in a table of buckets by block; and its name."""
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for batch in slices(batches, 64):
            held.append(batch)
            size += sum(map(len, filter(None, batch.column(text_column).cast(pa.binary()).to_pylist())))
            n += batch.num_rows
            if size >= BLOCK_BYTES or n >= BLOCK_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(held)], pa.binary())], names=["rows"])
                held, size, n = [], 0, 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(held)], pa.binary())], names=["rows"])

    name = f"docweir_{uuid.uuid4().hex}"
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.mapInArrow(pack, "rows binary").select(F.monotonically_increasing_id().alias("block"), "rows")
    path = f"{shared_dir(spark)}/{name}"
    rows.repartition(buckets, "block").write.option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name), name


def _each(batches: Iterator[pa.RecordBatch], id_column: str, text_column: str) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    """Each row that holds a block, one at a time, with its number."""
    for row in slices(batches, 1):
        yield row, row.column("block")[0].as_py(), Block(_unpacked(row.column("rows")[0].as_py()), id_column, text_column)


def _least(keys: list[np.ndarray], order: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key: the row that is first by order, and the greatest document."""
    by = np.lexsort([*order[::-1], *keys[::-1]])
    if not len(by):
        return by, doc[by]
    fresh = np.zeros(len(by), bool)
    fresh[0] = True
    for k in keys:
        fresh[1:] |= k[by][1:] != k[by][:-1]
    return by[fresh], np.maximum.reduceat(doc[by], np.flatnonzero(fresh))


def _listed(column: pa.Array, name: str) -> np.ndarray:
    """A field of the first row's list of structs."""
    return column.slice(0, 1).flatten().field(name).to_numpy(zero_copy_only=False)


def _chained(group: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) rows, in the order of (group, place), of chains whose places follow each other within an anchor's length; and that order."""
    by = np.lexsort([place, *group[::-1]])
    start = np.ones(len(by), bool)
    for g in group:
        start[1:] &= g[by][1:] == g[by][:-1]
    start[1:] = ~(start[1:] & (np.diff(place[by]) <= ANCHOR))
    first = np.flatnonzero(start)
    return by[first], by[np.append(first[1:], len(by)) - 1]


ANCHORS = "h long, block long, doc long, place int, top long"
EXTENDED = "block long, spans binary, g1 long, g2 long, doc long, top long"


def _extend(block: Block, h: np.ndarray, rep_doc: np.ndarray, rep_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the repeated anchors say of a block: whether a window that begins at a place is proven to stand in an earlier
    document, and whether it may be anywhere else at all and has to be compared."""
    n, own = len(block.words), block.anchors()
    by = np.argsort(h)
    found = np.searchsorted(h[by], own)
    known = found < len(h)
    known[known] = h[by][found[known]] == own[known]
    at, which = block.at[known], by[found[known]]
    proven, doubtful = np.zeros(n, bool), np.zeros(n, bool)
    if not len(at):
        return proven, doubtful
    begin, end = block.begins[block.doc[at]], block.begins[block.doc[at] + 1]
    doubtful = covered(np.maximum(at - PERIOD + 1, begin), np.minimum(at + 1, end), n) & block.starts
    earlier = rep_doc[which] < block.ids[block.doc[at]]
    at, which = at[earlier], which[earlier]
    if len(at):
        first, last = _chained([block.doc[at], rep_doc[which], block.place[at] - rep_place[which]], at)
        length = at[last] + ANCHOR - at[first]
        whole = length >= WINDOW
        proven = covered(at[first][whole], at[first][whole] + length[whole] - WINDOW + 1, n)
    return proven, doubtful & ~proven


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, in text_column what is left of the text, with _dw_n_words, _dw_n_removed and _dw_spans (removed words, [start, end)).

    A word goes if a window of WINDOW words covers it whose words also begin somewhere in a document with a smaller id
    (an integer; null stands behind all). Windows are judged on the input. Kept words are joined by one blank, so a text
    loses its other white space; a null text stays null, an empty one empty, and neither has words. Rows with one id are one
    document to each other: repeated rows lose nothing to each other and the same to others. Texts of any length are
    read whole; an empty table gives an empty one; other columns stay, whatever they are called. The result is written to
    the shared folder.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with scratch(spark), short_shuffles(spark):
        held, name = _blocks(docs, text_column)
        try:
            return _judged(docs, held, id_column, text_column)
        finally:
            spark.sql(f"DROP TABLE {name}")
            drop_table(spark, f"{shared_dir(spark)}/{name}")


def _judged(docs: DataFrame, held: DataFrame, id_column: str, text_column: str) -> DataFrame:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, number, block in _each(batches, id_column, text_column):
            h, doc, place = block.anchors(), block.ids[block.doc[block.at]], block.place[block.at]
            row, top = _least([h], [doc, place], doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[row]), pa.array(np.full(len(row), number)), pa.array(doc[row]), pa.array(place[row].astype(np.int32)), pa.array(top)], names=["h", "block", "doc", "place", "top"]
            )

    same = W.partitionBy("h")
    met = held.mapInArrow(anchors, ANCHORS).withColumn("first", F.min(F.struct("doc", "place")).over(same)).withColumn("last", F.max("top").over(same))
    repeated = met.filter("first.doc < last").groupBy("block").agg(F.collect_list(F.struct("h", F.col("first.doc").alias("doc"), F.col("first.place").alias("place"))).alias("found"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, number, block in _each(batches, id_column, text_column):
            found = row.column("found")
            proven, doubtful = _extend(block, *(_listed(found, f) for f in ("h", "doc", "place")))
            at = np.flatnonzero(doubtful)
            g, doc = block.windows(at), block.ids[block.doc[at]]
            first, top = _least([*g], [doc], doc)
            edges = np.flatnonzero(np.diff(proven, prepend=False, append=False)).astype(np.int64)
            n = len(first)
            empty = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, number)), pa.concat_arrays([pa.array([edges.tobytes()], pa.binary()), empty]),
                 *(pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(x)]) for x in (g[0][first], g[1][first], doc[first], top))],
                names=["block", "spans", "g1", "g2", "doc", "top"],
            )

    extended = cut(held.join(repeated, "block").mapInArrow(extend, EXTENDED))
    same = W.partitionBy("g1", "g2")
    twice = extended.filter("g1 is not null").withColumn("first", F.min("doc").over(same)).filter("first < top")
    asked = twice.groupBy("block").agg(F.collect_list(F.struct("g1", "g2", F.col("first").alias("doc"))).alias("found"))
    proven = extended.filter("spans is not null").select("block", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, block in _each(batches, id_column, text_column):
            yield _without(block, row.column("spans")[0].as_py(), row.column("found"), text_column)

    added = T._parse_datatype_string("_dw_n_words long, _dw_n_removed long, _dw_spans array<struct<start:long,end:long>>")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    out, _ = write_table(held.join(proven, "block", "left").join(asked, "block", "left").select("block", "rows", "spans", "found").mapInArrow(remove, schema))
    return out


def _without(block: Block, spans: bytes | None, found: pa.Array, text_column: str) -> pa.RecordBatch:
    """The block's rows without the windows that are proven or found in an earlier document."""
    n = len(block.words)
    edges = np.frombuffer(spans or b"", np.int64)
    hit = covered(edges[::2], edges[1::2], n)
    if found[0].is_valid:
        g1, g2, first = (_listed(found, f) for f in ("g1", "g2", "doc"))
        at = np.flatnonzero(block.starts)
        own = block.windows(at)
        by = np.lexsort([g2, g1])
        table = np.rec.fromarrays([g1[by], g2[by]], names="a,b")
        low = np.searchsorted(table.a, own[0])
        # halves that are equal stand together; the other half says which of them it is
        for _ in range(int(np.unique(g1, return_counts=True)[1].max())):
            here = low < len(g1)
            here[here] = table.a[low[here]] == own[0][here]
            same = here.copy()
            same[here] = table.b[low[here]] == own[1][here]
            earlier = same.copy()
            earlier[same] = first[by][low[same]] < block.ids[block.doc[at[same]]]
            hit[at[earlier]] = True
            low = low + here
    starts = np.flatnonzero(hit)
    gone = covered(starts, starts + WINDOW, n)
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), block.begins[:-1]) if n else np.zeros(len(block.lengths), np.int64)
    removed[block.lengths == 0] = 0
    texts, out, kept = block.batch.column(text_column), [], []
    for k, (a, b) in enumerate(zip(block.begins[:-1].tolist(), block.begins[1:].tolist(), strict=True)):
        own, lost = block.words[a:b], []
        if removed[k]:
            edge = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False)).tolist()
            lost = [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)]
            own = [w for w, g in zip(own, gone[a:b].tolist(), strict=True) if not g]
        kept.append(b" ".join(own).decode() if texts[k].is_valid else None)
        out.append(lost)
    columns = dict(zip(block.batch.schema.names, block.batch.columns, strict=True)) | {text_column: pa.array(kept, texts.type)}
    spans_of = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([*columns.values(), pa.array(block.lengths), pa.array(removed), spans_of], names=[*columns, "_dw_n_words", "_dw_n_removed", "_dw_spans"])


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of words, of removed ones, and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = remove_repeats(docs)
    return left.select("doc_id", F.col("_dw_n_words").alias("n_words"), F.col("_dw_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], size: int = WINDOW) -> list[tuple[int, int, str]]:
    """What op11 returns of these rows, by a table of all windows; for tests."""
    ids = [LAST if i is None else i for i, _ in rows]
    words = [words_of((t or "").encode()) for _, t in rows]
    first: dict[tuple[bytes, ...], int] = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
 s AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
 f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
 r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM s JOIN f USING (g) WHERE first < doc_id),
 x AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY 1),
 u AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN r USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
