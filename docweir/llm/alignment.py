"""Cross-tokenizer alignment by an event sweep.

Each text is encoded by two tokenizers, A and B. Where a token ends is an event. The events of both go, in blocks by ranges
of bytes, to the document's partition, sorted by offset, and stream through a machine that keeps the open group, some
counts and a running digest: every event of a range ends one link between the token of A and the token of B that lie
before it, and an offset where both end closes a group. A second pass weighs each document's links by the number of
documents that hold their pair of ids, which the first has counted.

Texts are encoded in segments that neither tokenizer's tokens cross: a word with the blank or the line's end before it,
where only single blanks and line ends stand between words. The distinct segments of some megabytes of texts are encoded
once, A's many in one call and cut by their bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, blocks, bound_batches, cut, slices, table

#: Bytes of text in one block of events.
RANGE = 65_536
#: Bytes of texts whose distinct segments are encoded together, and segments in one call of A.
READ, JOINED = 8_000_000, 1_000
#: Pairs counted in a task before they are handed on, and of one broadcast of the second pass.
COUNTED, SENT = 4_000_000, 4_000_000
#: Unicode's white space, by code points. Fixed values.
BLANKS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A segment that is one word with the line's end before it or nothing, in the syntax of Arrow's expressions.
_WORD = r"\A\n?[^" + re.sub(r"\\u(....)", r"\\x{\1}", BLANKS) + r"]+\z"
_BORDER = re.compile(f"(?<=[^{BLANKS}])(?=[ \\n][^{BLANKS}])")
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for themselves, the others are numbered from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Both tokenizers, read from the bytes of their files, with the segments that they have encoded."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        alphabet, spec = byte_alphabet(), json.loads(a)
        entries: list[bytes] = [b""] * self.a.get_vocab_size(True)
        for piece, i in spec["model"]["vocab"].items():
            entries[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = entries
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.kind = np.dtype(np.uint16 if max(len(entries), len(pieces)) <= 65_536 else np.uint32)
        self.mark = self.b.piece_to_id(SPACE)
        # segments stand by themselves if no piece goes on after a word with a mark, or holds a line's end
        self.apart = not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    def segments(self, text: str) -> list[str]:
        """The segments of a blank and the text; one that begins with a blank and a word is called by what follows the blank."""
        return [s[1:] if s[0] == " " and s[1:2] and not re.match(f"[{BLANKS}]", s[1:]) else s for s in _BORDER.split(" " + text)] if self.apart else [" " + text]

    def _split(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The segments of all texts, one after the other, and how many each text has: those between blanks and before line ends
        where they are words, else by segments()."""
        listed = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts, flat = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64), listed.flatten()
        coded = flat.dictionary_encode()
        odd = ~_words(coded.dictionary) if self.apart else np.ones(len(coded.dictionary), bool)
        if odd.any():
            before = np.concatenate([[0], np.cumsum(counts)])
            pieces, at = [], 0
            for k in np.unique(np.searchsorted(before, np.flatnonzero(odd[coded.indices.to_numpy()]), "right") - 1).tolist():
                own = self.segments(text) if (text := texts[k].as_py()) else []
                pieces += [flat.slice(at, int(before[k]) - at), pa.array(own, flat.type)]
                at, counts[k] = int(before[k + 1]), len(own)
            coded = pa.concat_arrays([*pieces, flat.slice(at)]).dictionary_encode()
        return coded, counts

    def _ids_a(self, whole: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of segments, one after the other, and how many each has. The words, which come first, are encoded many at once where
        their bytes come back and each ends with a token."""
        calls = [whole[k : min(k + JOINED, words)] for k in range(0, words, JOINED)] + [[s] for s in whole[words:]]
        ids, counts = [], []
        for own, found in zip(calls, self.a.encode_batch_fast(["".join(c) for c in calls], add_special_tokens=False), strict=True):
            got = [found.ids]
            if len(own) > 1:
                bytes_of = list(map(self.bytes_a.__getitem__, got[0]))
                ends = np.cumsum(np.fromiter(map(len, bytes_of), np.int64, len(bytes_of)))
                want = np.cumsum([len(s.encode()) for s in own])
                if b"".join(bytes_of) == "".join(own).encode() and np.isin(want, ends).all():
                    ids.append(np.array(got[0], self.kind))
                    counts.append(np.diff(np.searchsorted(ends, want, "right"), prepend=0))
                    continue
                got = [e.ids for e in self.a.encode_batch_fast(own, add_special_tokens=False)]
            ids += [np.array(x, self.kind) for x in got]
            counts.append(np.array(list(map(len, got)), np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def _ids_b(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of segments, one after the other, and how many each has."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in whole], num_threads=1)
        for k, s in enumerate(whole):
            if s[0] == "\n":  # the library puts a mark before it
                if found[k][0] != self.mark:
                    raise ValueError(f"the library joins the mark to {s[:100]!r}")
                del found[k][0]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for own in found for i in own), self.kind, int(counts.sum())), counts

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and of B for each text; None for one without tokens."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        coded, counts = self._split(texts)
        if not len(coded):
            yield from [None] * len(texts)
            return
        # words first, so that few calls have others
        word, named = _words(coded.dictionary), coded.dictionary.to_pylist()
        order = np.argsort(~word, kind="stable")
        whole = [s if s[0] in " \n" else " " + s for s in map(named.__getitem__, order.tolist())]
        of = np.empty(len(order), np.int64)
        of[order] = np.arange(len(order))
        of = of[coded.indices.to_numpy()]
        sides, spans, odd = [], [], np.zeros(len(whole), bool)
        for (ids, n), entries in ((self._ids_a(whole, int(word.sum())), self.bytes_a), (self._ids_b(whole), self.bytes_b)):
            starts = np.cumsum(n) - n
            odd |= _differing(whole, ids, starts, n, entries)
            own = n[of]
            ends = np.cumsum(own)
            sides.append(ids[np.arange(ends[-1]) + np.repeat(starts[of] - (ends - own), own)])
            spans.append(np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist())
        differs = np.append(0, np.cumsum(odd[of]))[np.append(0, np.cumsum(counts))]
        for k, n in enumerate(counts.tolist()):
            a, b = (ids[at[k] : at[k + 1]] for ids, at in zip(sides, spans, strict=True))
            if n and differs[k + 1] > differs[k]:
                want = (" " + texts[k].as_py()).encode()
                if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
                    n = 0
            yield (a, b) if n else None


def _words(segments: pa.Array) -> np.ndarray:
    """Which segments are a word with the line's end before it or nothing."""
    return pc.match_substring_regex(segments, _WORD).to_numpy(zero_copy_only=False)


def _differing(whole: list[str], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, entries: list[bytes]) -> np.ndarray:
    """Which segments are not the bytes of their tokens, looked at one by one only where a stretch of them differs."""
    out = np.zeros(len(whole), bool)
    for k in range(0, len(whole), JOINED):
        own, begin, n = whole[k : k + JOINED], starts[k : k + JOINED], counts[k : k + JOINED]
        tokens = list(map(entries.__getitem__, ids[begin[0] : begin[-1] + n[-1]].tolist()))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))))
        cuts = ends[np.append(begin - begin[0], len(tokens))]
        encoded = [s.encode() for s in own]
        if b"".join(tokens) != b"".join(encoded) or (np.diff(cuts) != np.array(list(map(len, encoded)))).any():
            at = np.append(begin - begin[0], len(tokens)).tolist()
            out[k : k + JOINED] = [b"".join(tokens[x:y]) != s for x, y, s in zip(at, at[1:], encoded, strict=False)]
    return out


_encoders: dict[bytes, Encoder] = {}


def encoder_of(files: tuple[bytes, bytes]) -> Encoder:
    """One encoder, with what it has learnt, for each worker process."""
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(*files)
    return _encoders[key]


def read_vocabularies(a: str | None = None, b: str | None = None) -> tuple[bytes, bytes]:
    """The bytes of both vocabulary files on the driver; by default those of the public byte-level and piece vocabularies."""
    import public_tokenizers

    out = []
    for path, name in ((a, "byte_bpe_50k.json"), (b, "piece_bpe_32k.model")):
        with open(path or public_tokenizers.path(name), "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end of each link, its A token, its B token, whether both end there) of tokens that end at these offsets; a token beyond the last is numbered behind it."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")
    fresh = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=fresh[1:])
    at = both[fresh]
    a, b = np.searchsorted(ends_a, at), np.searchsorted(ends_b, at)
    held = np.append(np.diff(np.flatnonzero(fresh)), len(both) - np.flatnonzero(fresh)[-1]) > 1 if len(both) else np.zeros(0, bool)
    return at, a, b, held


class Sweep:
    """The machine that a document's blocks of events stream through, in the order of their offsets."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], texts: np.ndarray, kind: np.dtype) -> None:
        self.lengths, self.texts, self.kind, self.pairs_of = lengths, texts, kind, len(lengths[1])
        self.begin()

    def begin(self) -> None:
        """The state before a document's first event."""
        self.digest, self.first = hashlib.sha256(), True
        self.counts = [0, 0, 0, 0]  # tokens of A, tokens of B, groups, links
        self.open = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # ids and ends of the open group
        self.held: list[list[np.ndarray]] = [[], []]
        self.pairs: list[np.ndarray] = []

    def step(self, start: tuple[int, int], ids: tuple[np.ndarray, np.ndarray], ahead: tuple[int, int]) -> None:
        """One range: for A and for B where its first token starts, its ids, and the id of the token after them."""
        ends = [s + np.cumsum(length[i]) for s, i, length in zip(start, ids, self.lengths, strict=True)]
        at, a, b, both = links(*ends)
        a, b = (np.append(i, max(0, n)).astype(np.int64)[k] for i, n, k in zip(ids, ahead, (a, b), strict=True))
        self.pairs.append(a * self.pairs_of + b)
        for k in (0, 1):
            self.held[k].append(ids[k])
            self.open[k] = np.concatenate([self.open[k][0], ids[k].astype(np.int64)]), np.concatenate([self.open[k][1], ends[k]])
            self.counts[k] += len(ids[k])
        self.counts[3] += len(at)
        closed = at[both]
        if len(closed):
            self.counts[2] += len(closed)
            self._close(closed)

    def whole(self, squeezed: list[tuple[bytes, bytes]]) -> tuple[list[dict[str, object]], np.ndarray]:
        """What end() says of documents that are one range each, taken together: they have as many bytes on either side, so their
        tokens in a row link as if they were one text. And the pairs of each, once a document."""
        held = [[np.frombuffer(_unsqueezed(x[k]), self.kind) for x in squeezed] for k in (0, 1)]
        n = [np.array(list(map(len, h)), np.int64) for h in held]
        ids = [np.concatenate(h) for h in held]
        ends = [np.cumsum(length[i]) for i, length in zip(ids, self.lengths, strict=True)]
        at, a, b, both = links(*ends)
        closed, over = at[both], ends[0][np.cumsum(n[0]) - 1]
        linked = np.diff(np.searchsorted(at, over, "right"), prepend=0)
        grouped = np.diff(np.searchsorted(closed, over, "right"), prepend=0)
        text = self._written(ids, ends, closed)
        cuts = np.append(0, np.cumsum(n[0] + n[1])).tolist()
        digests = [hashlib.sha256(text[x:y].tobytes().replace(b"\0", b"")[:-1]).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)]
        names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "b_ids")
        rows = zip(*(x.tolist() for x in (*n, grouped, linked)), digests, *zip(*squeezed, strict=True), strict=True)
        size = len(self.lengths[0]) * self.pairs_of
        own = np.sort(np.repeat(np.arange(len(n[0])), linked) * size + ids[0][a].astype(np.int64) * self.pairs_of + ids[1][b])
        return [dict(zip(names, r, strict=True)) for r in rows], own[np.append(True, own[1:] != own[:-1])] % size

    def _written(self, ids: list[np.ndarray], ends: list[np.ndarray], closed: np.ndarray) -> np.ndarray:
        """The texts of tokens whose groups end at these offsets, in the order of groups, with the signs behind them."""
        rows, order = [], []
        for k in (0, 1):
            group = np.searchsorted(closed, ends[k])
            last = np.append(group[1:] != group[:-1], True)
            rows.append(self.texts[np.where(last, 1 + k, 0), ids[k]])
            order.append(2 * group + k)
        return np.concatenate(rows)[np.argsort(np.concatenate(order), kind="stable")]

    def _close(self, closed: np.ndarray) -> None:
        """Write the groups that end at these offsets; what lies behind stays open."""
        done = []
        for k in (0, 1):
            ids, ends = self.open[k]
            n = int(np.searchsorted(ends, closed[-1], "right"))
            done.append((ids[:n], ends[:n]))
            self.open[k] = ids[n:], ends[n:]
        text = self._written(*map(list, zip(*done, strict=True)), closed).tobytes().replace(b"\0", b"")
        self.digest.update(text[:-1] if self.first else b";" + text[:-1])
        self.first = False

    def end(self) -> dict[str, object]:
        """What is known of the document after its last event."""
        names = ("n_a", "n_b", "n_groups", "n_links")
        ids = (np.concatenate(h).tobytes() if h else b"" for h in self.held)
        return dict(zip(names, self.counts, strict=True)) | {"groups_sha256": self.digest.hexdigest() if self.counts[0] else ""} | dict(zip(("a_ids", "b_ids"), map(_squeezed, ids), strict=True))


def id_texts(size: int) -> np.ndarray:
    """Decimal ids with a comma (row 0), the bar after A's last (1) and the semicolon after B's last (2)."""
    plain = [str(i).encode() for i in range(size)]
    return np.array([[p + sign for p in plain] for sign in (b",", b"|", b";")])


_CODEC = pa.Codec("zstd")


def _squeezed(data: bytes) -> bytes:
    """The length, then the data compressed."""
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True) if data else b""


def _unsqueezed(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True) if data else b""


EVENTS = "_dw_row long, _dw_at long, _dw_side byte, _dw_start long, _dw_ids binary, _dw_ahead int, _dw_last boolean"
SWEPT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids binary, b_ids binary"


def _joined(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes in a column."""
    held, n = [], 0
    for batch in slices(batches, 64):
        held.append(batch)
        n += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if n >= size or len(held) * 64 >= size // 256:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _events(docs: DataFrame, sent: object, keep: list[str]) -> DataFrame:
    """The union of A's and B's end events, in blocks by range; a text without tokens has one block of neither."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(EVENTS)])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema, timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        sizes = [np.array(list(map(len, x)), np.int64) for x in (encoder.bytes_a, encoder.bytes_b)]
        for batch in _joined(batches, "_dw_text", READ):
            source, rows = [], []
            numbers = batch.column("_dw_row").to_pylist()
            for k, found in enumerate(encoder.encode(batch.column("_dw_text"))):
                if found is None:
                    source.append(k)
                    rows.append((numbers[k], 0, 2, 0, b"", -1, True))
                    continue
                for side, ids in enumerate(found):
                    ends = np.cumsum(sizes[side][ids])
                    n = max(1, -(-int(ends[-1]) // RANGE))
                    cuts = [0, *np.searchsorted(ends, RANGE * np.arange(1, n), "right").tolist(), len(ids)] if n > 1 else [0, len(ids)]
                    for j in range(n):
                        a, b = cuts[j], cuts[j + 1]
                        source.append(k)
                        rows.append((numbers[k], j * RANGE, side, int(ends[a - 1]) if a else 0, _squeezed(ids[a:b].tobytes()), int(ids[b]) if b < len(ids) else -1, j == n - 1))
            own = list(zip(*rows, strict=True)) or [[]] * 7
            kept = [batch.column(c).take(pa.array(source, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(x), f.type) for x, f in zip(own, list(target)[len(keep) :], strict=True))], names=target.names)

    return docs.select(*keep, F.col("text").alias("_dw_text"), F.monotonically_increasing_id().alias("_dw_row")).mapInArrow(run, schema)


def sweep(docs: DataFrame, files: tuple[bytes, bytes] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of two kinds, in the shared folder. Of each document: the kept columns, n_a, n_b, n_groups, n_links, groups_sha256 and
    both sides' ids. Of the corpus, where pairs isn't null: pairs of ids (A's id times B's size plus B's id) and in how many
    documents of a task each is linked.

    docs has a column text and is read from a table: rows are numbered by their place in it. Null and empty texts, and
    those that either tokenizer doesn't give back byte by byte, have zeros, and '' for the digest. Every row is a
    document, repeated rows too, however long; an empty table gives an empty one. keep (doc_id, if not said) names the
    columns that stay.
    """
    spark, keep = docs.sparkSession, list(keep if keep is not None else ["doc_id"])
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(files or read_vocabularies())
    events = _events(docs, sent, keep)
    dealt = events.repartition("_dw_row").sortWithinPartitions("_dw_row", "_dw_at", "_dw_side")
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(SWEPT + ", pairs binary, docs binary")])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema, timestamp_utc=True)
    names = [f.name for f in T._parse_datatype_string(SWEPT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        sizes = tuple(np.array(list(map(len, x)), np.int64) for x in (encoder.bytes_a, encoder.bytes_b))
        machine, tally = Sweep(sizes, id_texts(max(map(len, sizes))), encoder.kind), Tally()
        block: list[tuple] = []
        for batch in slices(batches, 256):
            side, start, ahead, last = (batch.column(c).to_pylist() for c in ("_dw_side", "_dw_start", "_dw_ahead", "_dw_last"))
            ids, at = batch.column("_dw_ids").to_pylist(), batch.column("_dw_at").to_pylist()
            alone = [k for k in range(batch.num_rows - 1) if side[k] == 0 and last[k] and at[k] == 0]
            source, done = [k + 1 for k in alone], []
            if alone:
                done, pairs = machine.whole([(ids[k], ids[k + 1]) for k in alone])
                tally.count(pairs)
            taken = {*alone, *source}
            for k in range(batch.num_rows):
                if k in taken:
                    continue
                if side[k] < 2:
                    block.append((start[k], np.frombuffer(_unsqueezed(ids[k]), encoder.kind), ahead[k]))
                    if side[k] == 0:
                        continue
                    machine.step(*zip(*block, strict=True))
                    block = []
                if last[k]:
                    source.append(k)
                    done.append(machine.end())
                    tally.add(machine.pairs)
                    machine.begin()
            yield _rows(batch, source, [[d[n] for d in done] for n in names], keep, target)
            if tally.full():
                yield from tally.rows(target)
        yield from tally.rows(target)

    return cut(dealt.mapInArrow(run, schema))


def _rows(batch: pa.RecordBatch, source: list[int], values: list[list], keep: list[str], target: pa.Schema) -> pa.RecordBatch:
    kept = [batch.column(c).take(pa.array(source, pa.int64())) for c in keep]
    fields = list(target)[len(keep) :]
    made = [pa.array(v, f.type) for v, f in zip(values, fields, strict=False)]
    return pa.RecordBatch.from_arrays([*kept, *made, *(pa.nulls(len(source), f.type) for f in fields[len(values) :])], names=target.names)


class Tally:
    """In how many documents of a task each pair is linked."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n = 0
        self.pairs, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: list[np.ndarray]) -> None:
        if pairs:
            own = np.sort(np.concatenate(pairs))
            self.count(own[np.append(True, own[1:] != own[:-1])])

    def count(self, own: np.ndarray) -> None:
        """Add pairs that come once for each document."""
        self.held.append(own)
        self.n += len(own)
        if self.n > COUNTED // 2:
            self.fold()

    def fold(self) -> None:
        if self.held:
            pairs = np.concatenate([self.pairs, *self.held])
            docs = np.concatenate([self.docs, np.ones(self.n, np.int64)])
            by = np.argsort(pairs)
            pairs = pairs[by]
            fresh = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            self.pairs, self.docs, self.held, self.n = pairs[fresh], np.add.reduceat(docs[by], fresh), [], 0

    def full(self) -> bool:
        return len(self.pairs) > COUNTED

    def rows(self, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        """What is counted so far, in rows of 50,000 pairs; then it begins anew."""
        self.fold()
        for k in range(0, len(self.pairs), 50_000):
            own = {"pairs": self.pairs[k : k + 50_000].tobytes(), "docs": self.docs[k : k + 50_000].tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([own[f.name]], f.type) if f.name in own else pa.nulls(1, f.type) for f in target], names=target.names)
        self.__init__()


def pair_counts(swept: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair of ids is linked, and whether no pair of its A id is in more; in the shared folder."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            pairs, docs = (np.frombuffer(row.column(c)[0].as_py(), np.int64) for c in ("pairs", "docs"))
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=["pair", "n"])

    counted = cut(swept.filter("pairs is not null").select("pairs", "docs").mapInArrow(spread, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.floor(F.col("pair") / F.lit(size_b)).cast("long")
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A at most
    return cut(counted.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def weigh(swept: DataFrame, counts: DataFrame, files: tuple[bytes, bytes], keep: list[str]) -> DataFrame:
    """The documents' rows of sweep() with n_best and count_sum. The counts are sent in blocks of SENT pairs, one pass for each."""
    spark = swept.sparkSession
    tokenizers = spark.sparkContext.broadcast(files)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes() for c, kind in (("pair", np.int64), ("n", np.int64), ("best", np.bool_))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], names=["pair", "n", "best"])

    packed = counts.mapInArrow(pack, "pair binary, n binary, best binary")
    documents = swept.filter("pairs is null").drop("pairs", "docs")
    stay = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "b_ids"]
    out = documents.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for block in blocks(packed, lambda r: len(r.pair) // 8, SENT):
        pair, n, best = (np.concatenate([np.frombuffer(r[c], kind) for r in block]) for c, kind in (("pair", np.int64), ("n", np.int64), ("best", np.bool_)))
        by = np.argsort(pair)
        sent = spark.sparkContext.broadcast((pair[by], n[by], best[by]))

        def add(batch: pa.RecordBatch, sent=sent) -> dict[str, object]:
            encoder = encoder_of(tokenizers.value)
            sizes = tuple(np.array(list(map(len, x)), np.int64) for x in (encoder.bytes_a, encoder.bytes_b))
            of = batch.column("n_links").to_numpy()
            found = _weights(batch, encoder.kind, sizes, sent.value)
            before = np.concatenate([[0], np.cumsum(of)])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in found]
            best, total = (s[before[1:]] - s[before[:-1]] for s in sums)
            return {"n_best": batch.column("n_best").to_numpy() + best, "count_sum": batch.column("count_sum").to_numpy() + total}

        out = arrow_map(out, add, "n_best long, count_sum long", [*stay, "n_best", "count_sum"], 128)
    return out


def _weights(batch: pa.RecordBatch, kind: np.dtype, sizes: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every link of the batch, whether its pair is a best one and its count; 0 for pairs of other blocks. Documents have
    as many bytes on either side, so their tokens in a row link as if they were one text."""
    a, b = (np.frombuffer(b"".join(map(_unsqueezed, batch.column(c).to_pylist())), kind) for c in ("a_ids", "b_ids"))
    pair, n, best = counts
    if not len(a) or not len(pair):
        total = int(batch.column("n_links").to_numpy().sum())
        return np.zeros(total, np.int64), np.zeros(total, np.int64)
    _, at_a, at_b, _ = links(np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b]))
    own = a.astype(np.int64)[at_a] * len(sizes[1]) + b[at_b]
    asked, back = np.unique(own, return_inverse=True)
    at = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
    here = pair[at] == asked
    return (here & best[at])[back].astype(np.int64), np.where(here, n[at], 0)[back]


def align(docs: DataFrame, a: str | None = None, b: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """sweep() and weigh() together: each document's counts, the digest of its groups, its ids on both sides (see ids_of()),
    and how many of its links have their A id's most frequent pair (n_best) and the sum of their pairs' counts (count_sum)."""
    files, keep = read_vocabularies(a, b), list(keep if keep is not None else ["doc_id"])
    swept = sweep(docs, files, keep)
    from sentencepiece import SentencePieceProcessor

    return weigh(swept, pair_counts(swept, SentencePieceProcessor(model_proto=files[1]).get_piece_size()), files, keep)


def ids_of(aligned: DataFrame, files: tuple[bytes, bytes], keep: list[str]) -> DataFrame:
    """The kept columns with groups (array of a, b: the ids of each group) and links (array of a, b)."""
    sent = aligned.sparkSession.sparkContext.broadcast(files)

    def spread(batch: pa.RecordBatch) -> dict[str, object]:
        encoder = encoder_of(sent.value)
        sizes = [np.array(list(map(len, x)), np.int64) for x in (encoder.bytes_a, encoder.bytes_b)]
        groups, linked = [], []
        for raw in zip(*(batch.column(c).to_pylist() for c in ("a_ids", "b_ids")), strict=True):
            ids = [np.frombuffer(_unsqueezed(x), encoder.kind).astype(np.int64) for x in raw]
            ends = [np.cumsum(s[i]) for s, i in zip(sizes, ids, strict=True)]
            at, a, b, both = links(*ends)
            cuts = [np.concatenate([[0], np.searchsorted(e, at[both], "right")]).tolist() for e in ends]
            groups.append([{"a": ids[0][p:q].tolist(), "b": ids[1][r:s].tolist()} for p, q, r, s in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)])
            linked.append([{"a": x, "b": y} for x, y in zip(ids[0][a].tolist(), ids[1][b].tolist(), strict=True)])
        return {"groups": groups, "links": linked}

    return arrow_map(aligned, spread, "groups array<struct<a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>", keep)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, groups and links under both tokenizers, and its links weighed over the corpus."""
    out = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, int, int, int, str]]:
    """What op12 returns of these texts but for doc_id, by comparing every token with every other; for tests."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = byte_alphabet()
    docs: list = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        other = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(SPACE, " ").encode() for i in ids_b]
        if not text or b"".join(parts) != (" " + text).encode() or b"".join(other) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        spans = lambda x: [(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))]
        sa, sb = spans(parts), spans(other)
        found = [(ids_a[i], ids_b[j]) for i, (p, q) in enumerate(sa) for j, (r, s) in enumerate(sb) if p < s and r < q]
        ends = sorted({q for _, q in sa} & {s for _, s in sb})
        groups, low = [], 0
        for end in ends:
            inside = lambda ids, own, low=low, end=end: ",".join(str(i) for i, (p, q) in zip(ids, own, strict=True) if low <= p and q <= end)
            groups.append(inside(ids_a, sa) + "|" + inside(ids_b, sb))
            low = end
        docs.append((ids_a, ids_b, groups, found))
    count: dict[tuple[int, int], int] = {}
    for *_, found in docs:
        for pair in set(found):
            count[pair] = count.get(pair, 0) + 1
    best: dict[int, int] = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (len(x), len(y), len(groups), len(found), sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "")
        for x, y, groups, found in docs
    ]
