"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by score and then by place: the best pair merges, its
neighbours join the agenda, and pairs whose symbols have changed since are passed over. A character that no piece holds
becomes its bytes' pieces. Short segments keep their agendas in one matrix, a row each, so the best pairs of thousands of
them merge at once; long ones have a heap. No piece crosses from a letter to the space mark after it (checked when the vocabulary is
read, else the whole text is one segment), so segments between such places merge by themselves. A text is cut into
stretches, a word with the blank or the line's end before it, and what a stretch's segments merge to is remembered by its
text. Every segment that is new to a worker, lone marks and ends of lines among them, is encoded and decoded by the
sentencepiece library too, those of a batch in one call, and a difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

SPACE = "▁"
#: Characters, and as many for each segment, that a worker remembers before the older half makes room; a worker outlives its
#: task, so this bounds later stages too.
REMEMBERED, OVERHEAD = 9_000_000, 20
#: Characters of a segment up to which its agenda is a row of a matrix, and rows of one.
SHORT, ROWS = 48, 2_048
#: Where stretches can't be told by single blanks, and their borders there.
_UNEVEN = re.compile(r"[ \n]{2}|\A[ \n]|[ \n]\Z")
_BORDER = re.compile(r"(?<=[^ \n])(?=[ \n][^ \n])")


class PieceModel:
    """A vocabulary of normal and byte pieces, read with the sentencepiece library from a path or from its bytes."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not train.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte fallback and no normalisation is needed")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.prefix = norm.add_dummy_prefix
        self.library = SentencePieceProcessor(model_proto=model)
        self.end = self.library.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == p.NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == p.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == p.BYTE}
        self.surface = [
            bytes([int(p.piece[3:5], 16)])
            if p.type == p.BYTE
            else p.piece.replace(SPACE, " ").encode()
            if p.type == p.NORMAL
            else b""
            if p.type == p.CONTROL
            else train.unk_surface.encode()
            for p in spec.pieces
        ]
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        lone = "\n" if not any("\n" in p for p in self.ids) else ""
        self.lone = "" if crossing else lone
        self.split = re.compile(f"{lone}|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        if crossing:
            self.split = lambda text: [text]
        self.apart = bool(self.lone) and self.prefix
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self._pairs()
        self.texts = np.array([f"{i} ".encode() for i in range(len(spec.pieces))])

    def merge(self, segment: str) -> tuple[int, ...]:
        """Ids of one segment, in which spaces are marked."""
        if len(segment) <= SHORT:
            return tuple(np.frombuffer(self.merge_rows([segment])[0], np.int32).tolist())
        score, symbols = self.score, list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-score[p], k, p) for k in range(n - 1) if (p := symbols[k] + symbols[k + 1]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, k, piece = heapq.heappop(agenda)
            right = after[k]
            if right >= n or symbols[k] is None or symbols[right] is None or symbols[k] + symbols[right] != piece:
                continue
            symbols[k], symbols[right] = piece, None
            after[k] = far = after[right]
            if far < n:
                before[far] = k
                if (p := piece + symbols[far]) in score:
                    heapq.heappush(agenda, (-score[p], k, p))
            if (left := before[k]) >= 0 and (p := symbols[left] + piece) in score:
                heapq.heappush(agenda, (-score[p], left, p))
        return self._ids_of(s for s in symbols if s is not None)

    def _pairs(self) -> None:
        """Number the symbols, pieces first and then characters that only stand in pieces, and list what two of them merge to."""
        texts = [*self.ids]
        self.symbol = {t: k for k, t in enumerate(texts)}
        for c in sorted(set(chain.from_iterable(texts))):
            self.symbol.setdefault(c, len(self.symbol))
        self.base = len(self.symbol)
        met = [(self.symbol[t[:k]] * self.base + self.symbol[t[k:]], n) for n, t in enumerate(texts) for k in range(1, len(t)) if t[:k] in self.symbol and t[k:] in self.symbol]
        pairs = np.array(sorted(met), np.int64).reshape(-1, 2)
        self.pair, self.merged = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], 0)
        self.costs = np.array([-self.score[t] for t in texts], np.float64)
        self.id_of = np.array([self.ids[t] for t in texts], np.int32)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, symbol) of merging these; no cost is lower than that of what doesn't merge."""
        asked = left * self.base + right
        asked[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair, asked)
        symbol = self.merged[at]
        return np.where(self.pair[at] == asked, self.costs[symbol], inf), symbol

    def merge_rows(self, segments: list[str]) -> list[bytes]:
        """Packed ids of short segments: in each row the cheapest pair merges, the first of equals, until none does."""
        n, size = len(segments), np.array([*map(len, segments)])
        width = int(size.max())
        letters = np.frombuffer("".join(s.ljust(width, "\0") for s in segments).encode("utf-32-le"), np.uint32).reshape(n, width)
        held, code = np.unique(letters, return_inverse=True)
        number = np.array([self.symbol.get(chr(c), -1) for c in held.tolist()], np.int64)
        symbol = number[code.reshape(n, width)]
        inside = np.arange(width) < size[:, None]
        symbol[~inside] = -2
        after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
        cost, made = np.full((n, width), inf), np.zeros((n, width), np.int64)
        cost[:, :-1], made[:, :-1] = self._looked_up(symbol[:, :-1], symbol[:, 1:])
        row = np.arange(n)
        while len(row):
            k = cost[row].argmin(axis=1)
            row, k = (x[cost[row, k] < inf] for x in (row, k))
            gone = after[row, k]
            far = after[row, gone]
            symbol[row, k], symbol[row, gone] = made[row, k], -2
            cost[row, gone], after[row, k] = inf, far
            there = far < width
            before[row[there], far[there]] = k[there]
            right = np.where(there, symbol[row, np.minimum(far, width - 1)], -2)
            cost[row, k], made[row, k] = self._looked_up(symbol[row, k], right)
            left = before[row, k]
            r, at, k = row[left >= 0], left[left >= 0], k[left >= 0]
            cost[r, at], made[r, at] = self._looked_up(symbol[r, at], symbol[r, k])
        stays = symbol != -2
        flat, odd = symbol[stays], (symbol < 0) | (symbol >= len(self.id_of))
        ids = self.id_of[np.minimum(np.maximum(flat, 0), len(self.id_of) - 1)].tobytes()
        ends = np.cumsum(stays.sum(axis=1)).tolist()
        out = [ids[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for r in np.flatnonzero((odd & stays).any(axis=1)).tolist():  # characters that no piece holds
            places = np.flatnonzero(stays[r])
            texts = [segments[r][a:b] for a, b in zip(places, [*places[1:], int(size[r])], strict=True)]
            out[r] = np.array(self._ids_of(texts), np.int32).tobytes()
        return out

    def _ids_of(self, symbols: Iterable[str]) -> tuple[int, ...]:
        symbols = [*symbols]
        try:
            return tuple(map(self.ids.__getitem__, symbols))
        except KeyError:
            own = ([self.ids[s]] if s in self.ids else [self.byte[b] for b in s.encode()] for s in symbols)
            return tuple(chain.from_iterable(own))

    def stretches(self, text: str) -> list[str]:
        """The text in stretches; one that begins with a blank and a word is called by what follows the blank."""
        if not text:
            return []
        if not self.apart:
            return [(" " if self.prefix else "") + text]
        if not _UNEVEN.search(text):
            return text.replace("\n", " \n").split(" ")
        return [s[1:] if s[0] == " " and s[1:2] not in ("", " ", "\n") else s for s in _BORDER.split(" " + text)]

    def learn(self, stretches: set[str]) -> None:
        """Merge the segments of the stretches not known yet and hold all of them against the library, encoded and decoded; a
        difference is an error."""
        if self.held > REMEMBERED:  # what the next batches use again comes back from the older half
            self.older, self.known, self.held = self.known, {}, 0
        known, older = self.known, self.older
        missing = [s for s in stretches if s not in known]
        new = []
        for s in missing:
            if s in older:
                known[s] = older[s]
            else:
                new.append(s)
        if new:
            marked = [s.replace(" ", SPACE) if not self.apart or s[0] in " \n" else SPACE + s.replace(" ", SPACE) for s in new]
            own = [*map(self.split, marked)]
            made = self.merge_all({*chain.from_iterable(own)})
            self.check([*made], [*made.values()])
            packed = made.__getitem__
            known.update((s, packed(x[0]) if len(x) == 1 else b"".join(map(packed, x))) for s, x in zip(new, own, strict=True))
        self.held += sum(map(len, missing)) + OVERHEAD * len(missing)

    def merge_all(self, segments: set[str]) -> dict[str, bytes]:
        """Packed ids of segments, the short ones merged by ROWS of about one length."""
        out = {s: np.array(self.merge(s), np.int32).tobytes() for s in segments if len(s) > SHORT}
        short = sorted((s for s in segments if len(s) <= SHORT), key=len)
        for k in range(0, len(short), ROWS):
            out.update(zip(short[k : k + ROWS], self.merge_rows(short[k : k + ROWS]), strict=True))
        return out

    def check(self, segments: list[str], made: list[bytes]) -> None:
        """Compare with the library, in one text whose lines are the segments where a line's end parts them, else one by one."""
        if not self.lone:
            asked = [s.replace(SPACE, " ") for s in segments]
            for s, text, packed in zip(segments, asked, made, strict=True):
                own, ids = text[1:] if self.prefix and text[:1] == " " else text, np.frombuffer(packed, np.int32).tolist()
                if self.library.encode(own, num_threads=1) != ids or self.library.decode(ids) != self.decode(ids):
                    raise ValueError(f"the library treats {s[:100]!r} otherwise")
            return
        line = np.array(self.merge(self.lone), np.int32).tobytes()
        # the library puts a mark before a text, which stands alone before the first line's end
        first = np.array(self.merge(SPACE), np.int32).tobytes() if self.prefix else b""
        ids = np.frombuffer(first + line + line.join(made), np.int32).tolist()
        text = self.lone + self.lone.join(segments).replace(SPACE, " ")
        if self.library.encode(text, num_threads=1) != ids or self.library.decode(ids) != self.decode(ids):
            raise ValueError(f"the library treats one of {len(segments)} segments from {segments[0][:100]!r} on otherwise")

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text with the end id last; a null is an empty text."""
        end = np.array([self.end], np.int32).tobytes()
        for k in range(0, len(texts), 200):
            own = [self.stretches(text or "") for text in texts[k : k + 200]]
            self.learn(set().union(*own))
            known = self.known.__getitem__
            for stretches in own:
                yield np.frombuffer(b"".join(map(known, stretches)) + end, np.int32)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode(texts)]

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self.texts[ids].tobytes().replace(b"\0", b"")[:-1]

    def decode(self, ids: list[int]) -> str:
        """The library's decode(): pieces joined, bytes joined to characters, the mark before the text taken away."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_models: dict[bytes, PieceModel] = {}


def model_of(data: bytes) -> PieceModel:
    """One model, with what it has learnt, for each worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def read_model(path: str | None = None) -> bytes:
    """The bytes of a vocabulary file on the driver; by default the public one of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if not said) with ids and decoded.

    Null texts count as empty; an empty text has the end id alone and decodes to an empty one. Every row is encoded by
    itself, however long, repeated rows alike. Own columns called ids or decoded give way; an empty table gives an empty one.
    """
    keep = list(docs.columns if keep is None else keep)
    sent = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def add(batch: pa.RecordBatch) -> dict[str, object]:
        model = model_of(sent.value)
        ids = [*model.encode(batch.column("text").to_pylist())]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        return {"ids": listed, "decoded": [model.decode(x.tolist()) for x in ids]}

    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), add, "ids array<int>, decoded string", keep)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of ids, and digests of the ids and of the text that they decode to."""
    sent = spark.sparkContext.broadcast(read_model())

    def digest(batch: pa.RecordBatch) -> dict[str, object]:
        model = model_of(sent.value)
        counts, ids_hash, text_hash = [], [], []
        for ids in model.encode(batch.column("text").to_pylist()):
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(model.joined(ids)).hexdigest())
            text_hash.append(hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest())
        return {"n_tokens": counts, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return arrow_map(docs, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])
