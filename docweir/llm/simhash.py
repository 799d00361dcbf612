"""SimHash near-duplicates, searched in BK-trees.

A BK-tree keys the children of a node by their Hamming distance to it, so a search of radius r around a query at
distance d follows only the edges d - r to d + r. One tree over all fingerprints would visit a large part of itself for
every query, so the fingerprints are first dealt into shards that no link can cross unseen: of four 16-bit blocks two
linked fingerprints share one, and of four 12-bit parts of the other 48 bits they share one again. A shard holds the
distinct fingerprints with one such pair of values, has its own tree, and is searched with its own members only. A
shard with more than TREE_LIMIT members is split into several trees; each is sent to every other part's members as
queries. Trees travel by the shuffle's key and never through the driver.

near_copies() adds the links of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, most of
which lie outside three bits. Candidates share one of BANDS bands of ROWS least hashes each, and every candidate is
checked on the shingles themselves, if their sketches don't rule it out. A pair at 0.8 shares no band with a chance of
(1 - 0.8 ** 4) ** 20 < 0.00003.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, slices, table
from .components import connected_components

SHINGLE = 3
RADIUS = 3
TREE_LIMIT = 20_000
#: Of near_copies(): words of a shingle, the least similarity, bands and their least hashes, hashes of a sketch, which keeps
#: four bits of each, and how many of these may differ. At a similarity of 0.8 24 differ, 45 or more with a chance of 0.00001.
WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
SKETCH, SKETCH_RADIUS = 128, 44
NIBBLES = 0x1111111111111111
#: Members of a band that are compared in pairs; a band with more is compared in parts of so many members.
SMALL_BAND, PART = 48, 1_000
FACTORS = np.random.default_rng(42).integers(1 << 62, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def digests_of(words: list[bytes], size: int) -> bytes:
    """XXH64 with seed 42 of each run of so many words, in order; of all words if they are fewer."""
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_digest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64 bits, as a signed integer; a bit is set if it is set in over half of the shingles' XXH64 with seed 42."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    table_ = np.frombuffer(digests_of(words, size), np.uint8).reshape(-1, 8)
    ones = np.stack([np.bincount(table_[:, k], minlength=256) for k in range(8)]) @ BITS_OF_BYTE
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(table_)).tobytes(), "big", signed=True)


def shingle_set(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted; none for a text without words."""
    words = text.lower().split() if text else []
    return np.unique(np.frombuffer(digests_of(words, size) if words else b"", ">u8")).astype(np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two shingle sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """SKETCH least hashes of a shingle set that isn't empty."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):  # bounds the memory that a long text takes
        np.minimum(least, (FACTORS[:, None] * shingles[at : at + 1024]).min(axis=1), out=least)
    return least


class BKTree:
    """Nodes are (value, children by distance)."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if not d:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def near(self, value: int, radius: int = RADIUS) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            other, children = open_.pop()
            d = (other ^ value).bit_count()
            if d <= radius:
                found.append(other)
            if children:
                open_ += [child for edge, child in children.items() if -radius <= edge - d <= radius]
        return found


def _block(k: int) -> F.Column:
    return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))


def _keys() -> list[F.Column]:
    keys = []
    for i in range(4):
        rest = [_block(k) for k in range(4) if k != i]
        other = F.shiftleft(rest[0], 32).bitwiseOR(F.shiftleft(rest[1], 16)).bitwiseOR(rest[2])
        for j in range(4):
            part = F.shiftrightunsigned(other, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(_block(i), 12).bitwiseOR(part) + F.lit((4 * i + j) << 28))
    return keys


class Shard:
    """One BK-tree and the classes that its members' links make."""

    def __init__(self, members: list[int]) -> None:
        self.tree, self.parent = BKTree(), {}
        for x in members:
            for y in self.tree.near(x):
                a, b = self.root(x), self.root(y)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
            self.tree.add(x)

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def links(self) -> list[tuple[int, int]]:
        """Each member that isn't the least of its class, with that least one."""
        return [(x, self.root(x)) for x in [*self.parent]]

    def links_of(self, x: int) -> list[tuple[int, int]]:
        """A query from elsewhere, with the least member of each class that it touches."""
        return [(x, y) for y in {self.root(y) for y in self.tree.near(x)}]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, list[int]]]:
    """Runs of rows of one (key, part) and role, cut at the ends of batches; a shard of one row alone is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, query, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "query", "fp"))
        fp = np.ascontiguousarray(fp).view(np.uint64)
        edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(query) != 0)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        wanted = (ends - starts > 1) | (query[starts] > 0)
        wanted[:-1] |= query[starts[1:]] > 0
        wanted[[0, -1]] = True  # it may go on in another batch
        for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
            yield (int(key[a]), int(part[a])), bool(query[a]), fp[a:b].tolist()  # without signs, so that xor has none


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, part, query): each (key, part) has its members, then the queries that other parts send."""
    links: list[tuple[int, int]] = []
    at, members, shard = None, [], None
    for place, is_query, values in _runs(batches):
        if place != at:
            if shard is None and len(members) > 1:
                links += Shard(members).links()
            at, members, shard = place, [], None
        if not is_query:
            members += values
        else:
            if shard is None:
                shard = Shard(members)
                links += shard.links()
            for x in values:
                links += shard.links_of(x)
        if len(links) >= 50_000:
            yield _as_batch(links)
            links = []
    if shard is None and len(members) > 1:
        links += Shard(members).links()
    yield _as_batch(links)


def _as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["a", "b"])


def near_links(prints: DataFrame, limit: int = TREE_LIMIT) -> DataFrame:
    """Links (a, b) between distinct values of fp whose transitive closure is that of all pairs within RADIUS bits."""
    keyed = prints.select("fp", F.explode(F.array(*_keys())).alias("key"))
    blocks = prints.select(F.explode(F.array(*[_block(k) + F.lit(k << 16) for k in range(4)])).alias("block"))
    crowded = blocks.groupBy("block").count().filter(F.col("count") > limit)
    parts, one = F.lit(1), F.lit(0).cast("long")
    if not crowded.isEmpty():  # else no shard can be over the limit
        large = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / limit).cast("long").alias("parts")).filter("parts > 1")
        keyed = keyed.join(cut(large), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        parts, one = F.col("parts"), F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
    sent = keyed.withColumn("own", one).withColumn("all", parts.cast("long"))
    # each part's members are queries to the trees of the later parts, so that each two parts meet once
    sent = sent.select("fp", "key", "own", F.explode(F.sequence(F.col("own"), F.col("all") - 1)).alias("part"))
    sent = sent.select("key", "part", F.when(F.col("part") == F.col("own"), 0).otherwise(1).alias("query"), "fp")
    dealt = sent.repartition("key", "part").sortWithinPartitions("key", "part", "query", "fp")
    return dealt.mapInArrow(_search, "a long, b long")


def fingerprints(docs: DataFrame, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """The kept columns with fp, the fingerprint as a signed long."""

    def add(batch: pa.RecordBatch) -> dict[str, object]:
        return {"fp": [fingerprint(x, size) for x in batch.column("text").cast(pa.binary()).to_pylist()]}

    return arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), add, "fp long", keep)


def _roots(prints: DataFrame) -> DataFrame:
    """(fp, root): each fingerprint with a link within RADIUS bits, and the smallest that its links reach."""
    return cut(connected_components(near_links(prints.select("fp"))).toDF("fp", "root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the class of each row among fingerprints linked at RADIUS or fewer differing bits.

    component_id is the smallest doc_id of the class. Null and empty texts have fingerprint zero and are linked like any
    other. Repeated rows stay and share a class. Other columns are not read.
    """
    prints = cut(fingerprints(docs, ["doc_id"]))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    return _classed(prints, distinct, _roots(distinct), "doc_id").select("doc_id", "fp", "component_id")


def _classed(prints: DataFrame, distinct: DataFrame, roots: DataFrame, own: str) -> DataFrame:
    """prints with component_id, the smallest value of the column own among the fingerprints of one root."""
    labelled = distinct.join(roots, "fp", "left").select("fp", "least", "n", "root")
    least = labelled.filter("root is not null").groupBy("root").agg(F.min("least").alias("_dw_least"))
    # a fingerprint that one row has and that has no link needs no lookup
    classes = labelled.filter("root is not null or n > 1").join(least, "root", "left")
    classes = cut(classes.select(F.col("fp").alias("_dw_fp"), F.coalesce("_dw_least", "least").alias("_dw_class")))
    joined = prints.join(classes, prints["fp"] == classes["_dw_fp"], "left")
    return joined.select(*(prints[c] for c in prints.columns), F.coalesce("_dw_class", own).alias("component_id"))


def _sketches(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, fingerprint, digests of the text and of its shingle set, the set's size, sketch and bands."""
    shifts = np.arange(0, 64, 4, dtype=np.uint64)

    def add(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("fp", "set", "size", "sketch", "bands")}
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            shingles = shingle_set(text)
            out["fp"].append(fingerprint(text))
            out["set"].append(int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64)))
            out["size"].append(len(shingles))
            least = least_hashes(shingles) if len(shingles) else np.zeros(SKETCH, np.uint64)
            parts = (least >> np.uint64(20) & np.uint64(15)).reshape(-1, 16) << shifts
            out["sketch"].append(np.bitwise_or.reduce(parts, axis=1).view(np.int64).tolist())
            bands = [xxhash.xxh64_digest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)] if len(shingles) else []
            out["bands"].append(np.frombuffer(b"".join(bands), np.int64).tolist())
        return out

    read = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return arrow_map(read, add, "fp long, set long, size int, sketch array<long>, bands array<long>", ["doc_id", "digest"])


def _differing(a: F.Column, b: F.Column) -> F.Column:
    """In how many least hashes two sketches differ."""
    out = F.lit(0)
    for k in range(SKETCH // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for by in (1, 2, 3):
            x = x.bitwiseOR(F.shiftrightunsigned(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))), by))
        out = out + F.bit_count(x.bitwiseAND(F.lit(NIBBLES)))
    return out


def _texts(asked: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, text): one text of each shingle set asked for."""
    asked = cut(asked.join(sets.select("set", "digest"), "set"))
    texts = docs.select("text", F.xxhash64("text").alias("digest")).join(asked.hint("shuffle_hash"), "digest")
    return cut(texts.groupBy("set").agg(F.min("text").alias("text")))


def _alike(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): of pairs (a, b, set_a, set_b) those whose shingle sets are as similar as SIMILAR, checked on their texts."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    texts = _texts(pairs.select(F.col("set_a").alias("set")).unionByName(pairs.select(F.col("set_b").alias("set"))).distinct(), docs, sets)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def shingles(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) > 64:
                    known.clear()
                known[key] = shingle_set(text.encode())
            return known[key]

        for batch in slices(batches, 64):
            links = [
                (a, b)
                for a, b, set_a, set_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b", "x", "y")), strict=True)
                if jaccard(shingles(set_a, x), shingles(set_b, y)) >= SIMILAR
            ]
            yield _as_links(links)

    first, second = texts.toDF("set_a", "x").hint("merge"), texts.toDF("set_b", "y").hint("merge")
    return pairs.join(first, "set_a").join(second, "set_b").select("a", "b", "set_a", "set_b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def _near(a: str, b: str) -> F.Column:
    """Whether sizes and sketches allow the least similarity."""
    sizes = F.least(f"{a}size", f"{b}size") >= F.greatest(f"{a}size", f"{b}size") * SIMILAR - 0.001
    return sizes & (_differing(F.col(f"{a}sketch"), F.col(f"{b}sketch")) <= SKETCH_RADIUS)


def _undecided(members: DataFrame) -> DataFrame:
    """Members of the bands that still hold several classes, with n, how many the band has."""
    open_ = members.groupBy("band").agg(F.min("top").alias("low"), F.max("top").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("band", "n")
    # written down, so that Spark can split the rows of a band that very many texts share
    return cut(members.join(cut(open_), "band"))


def _head_pairs(members: DataFrame) -> DataFrame:
    """(a, b, set_a, set_b): each member with its band's first one by node, if it is of another class."""
    heads = cut(members.groupBy("band").agg(F.min(F.struct("node", "set", "size", "sketch", "top")).alias("head")))
    met = members.join(heads, "band").filter((F.col("top") != F.col("head.top")) & _near("", "head."))
    return cut(met.select(F.col("node").alias("a"), F.col("head.node").alias("b"), F.col("set").alias("set_a"), F.col("head.set").alias("set_b")).distinct())


def _small_pairs(members: DataFrame) -> DataFrame:
    """(a, b, set_a, set_b): members of two classes in bands of SMALL_BAND members or fewer, so each meets few others."""
    x, y = members.alias("x"), members.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.top") < F.col("y.top")) & _near("x.", "y."))
    return cut(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.set").alias("set_a"), F.col("y.set").alias("set_b")).distinct())


class Block:
    """The shingle sets of some members of one band, by which all similarities with one more set are counted at once."""

    def __init__(self, nodes: list[int], tops: list[int], sets: list[np.ndarray]) -> None:
        self.nodes, self.tops, self.sets = nodes, tops, sets
        self.sizes = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.values, self.owners = every[order], owner[order]
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def links_of(self, node: int, top: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """Links of a member, its own or another part's, that join classes not joined so far."""
        low, high = np.searchsorted(self.values, shingles, "left"), np.searchsorted(self.values, shingles, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owners[at], minlength=len(self.nodes))
        out = []
        for k in np.flatnonzero(both >= SIMILAR * (self.sizes + len(shingles) - both)).tolist():
            x, y = self.root(top), self.root(self.tops[k])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                out.append((node, self.nodes[k]))
        return out

    def links(self) -> list[tuple[int, int]]:
        """Links among the members: those of the largest class need no comparison with each other."""
        largest = Counter(self.tops).most_common(1)[0][0]
        return [x for k in range(len(self.nodes)) if self.tops[k] != largest for x in self.links_of(self.nodes[k], self.tops[k], self.sets[k])]


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (band, part, query): the members of a part, then those that other parts send to it."""
    at, held, block, known = None, [], None, {}

    def done() -> list[tuple[int, int]]:
        return Block(*map(list, zip(*held, strict=True))).links() if held and block is None else []

    for batch in slices(batches, 64):
        links: list[tuple[int, int]] = []
        for band, part, query, set_, node, top, text in zip(*(batch.column(c).to_pylist() for c in ("band", "part", "query", "set", "node", "top", "text")), strict=True):
            if (band, part) != at:
                links += done()
                at, held, block = (band, part), [], None
            if set_ not in known:
                if len(known) > PART:
                    known.clear()
                known[set_] = shingle_set(text.encode())
            if not query:
                held.append((node, top, known[set_]))
                continue
            if block is None:
                block = Block(*map(list, zip(*held, strict=True))) if held else None
                links += block.links() if block else []
            if block:
                links += block.links_of(node, top, known[set_])
        yield _as_links(links)
    yield _as_links(done())


def _as_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _large_links(members: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links in bands of more members, which are dealt into parts of about PART; each two parts meet once."""
    if members.isEmpty():
        return members.select(F.col("node").alias("a"), F.col("top").alias("b"))
    parts = F.ceil(F.col("n") / PART).cast("long")
    own = members.withColumn("all", parts).withColumn("own", F.pmod(F.xxhash64("set"), F.col("all")))
    texts = _texts(members.select("set").distinct(), docs, sets)
    sent = own.select("band", "set", "node", "top", "own", F.explode(F.sequence(F.col("own"), F.col("all") - 1)).alias("part"))
    sent = sent.select("band", "part", (F.col("part") != F.col("own")).alias("query"), "set", "node", "top").join(texts.hint("shuffle_hash"), "set")
    dealt = sent.select("band", "part", "query", "set", "node", "top", "text").repartition("band", "part").sortWithinPartitions("band", "part", "query")
    return dealt.mapInArrow(_search_blocks, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(row, fp, component_id): the classes of near_duplicates(), joined where texts are as similar as SIMILAR.

    row is struct<nameless, doc_id, digest>, which rows of one doc_id and one text share and no others do; component_id is
    the smallest row of the class, so rows without a doc_id come last. Null and empty texts are alike. Other columns are not
    read, and an empty table gives no rows. Links are looked for between classes only: first each member of a band against
    one head of the band, which joins most copies by as many checks as there are members; then, in bands whose classes still
    differ, all members of different classes, in pairs where the band is small, else in blocks that count a member's
    similarities with all others at once.
    """
    prints = cut(_sketches(docs).withColumn("row", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")))
    distinct = cut(prints.groupBy("fp").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = _roots(distinct)
    marks = F.struct("size", "sketch", "bands", "digest")  # a set's texts differ in order or case at most
    of_set = prints.groupBy("set", "fp").agg(F.min(marks).alias("m")).join(roots, "fp", "left")
    of_set = cut(of_set.select("set", F.coalesce("root", "fp").alias("node"), "m"))
    sets = cut(of_set.groupBy("set").agg(F.min("node").alias("node"), F.max("node").alias("far"), F.min("m").alias("m")).select("set", "node", "far", "m.*"))
    links = of_set.join(sets.filter("node < far").select("set", F.col("node").alias("b")), "set").select(F.col("node").alias("a"), "b").filter("a <> b")
    links = cut(links)
    members = sets.select("set", "node", "size", "sketch", F.col("node").alias("top"), F.explode("bands").alias("band"))
    members = _undecided(members)
    links = cut(links.unionByName(_alike(_head_pairs(members), docs, sets)))
    joined = cut(connected_components(links).toDF("node", "_dw_top"))
    members = members.drop("top", "n").join(joined, "node", "left").withColumn("top", F.coalesce("_dw_top", "node")).drop("_dw_top")
    members = _undecided(members)
    links = links.unionByName(_alike(_small_pairs(members.filter(F.col("n") <= SMALL_BAND)), docs, sets))
    links = cut(links.unionByName(_large_links(members.filter(F.col("n") > SMALL_BAND), docs, sets)))
    # fingerprints of one class share a node; the new links join nodes
    joined = cut(connected_components(links).toDF("root", "top"))
    classes = distinct.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")).join(joined, "root", "left")
    return _classed(prints.select("row", "fp"), distinct, cut(classes.select("fp", F.coalesce("top", "root").alias("root"))), "row")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of docs with the smallest (doc_id, digest of the text) of each class of near_copies(), once if it is repeated.

    Rows without a doc_id stay only in classes without any other. All columns of docs stay as they are.
    """
    named = docs.columns
    kept = near_copies(docs).filter("row = component_id").groupBy("row.doc_id", "row.digest").agg(F.count(F.lit(1)).alias("n"))
    kept = cut(kept.select(F.col("doc_id").alias("_dw_id"), F.col("digest").alias("_dw_of"), F.col("n").alias("_dw_n")))
    # the kept rows grow with the documents, so they are never broadcast, however few they are; hashing them saves a sort of the texts
    met = docs["doc_id"].eqNullSafe(kept["_dw_id"]) & (F.xxhash64(docs["text"]) == kept["_dw_of"])
    if kept.filter("_dw_n > 1").isEmpty():
        return docs.join(kept.hint("shuffle_hash"), met, "left_semi").select(*named)
    met = docs.join(kept.hint("shuffle_hash"), met).select(F.struct(*(docs[c] for c in named)).alias("_dw_row"), "_dw_id", "_dw_of", "_dw_n")
    again = met.filter("_dw_n > 1").groupBy("_dw_id", "_dw_of").agg(F.first("_dw_row").alias("_dw_row"))
    return met.filter("_dw_n = 1").select("_dw_row").unionByName(again.select("_dw_row")).select("_dw_row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, and the smallest doc_id that its links reach."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[str, int]]:
    """What op2 returns, by comparing all pairs; for tests."""
    import re

    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if (prints[i] ^ prints[j]).bit_count() <= RADIUS and least[j] < least[i]:
                    least[i], changed = least[j], True
    return {i: (f"{prints[i]:016x}", least[i]) for i in texts}
