"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted to at most SAMPLE_ROWS vectors on the driver; leaves that more than LEAF_ROWS vectors fall into get
subtrees, each fitted in a task to at most about SUB_ROWS of the leaf's own vectors, so leaves keep their size as the
table grows. Its centroids are sent to all tasks, which TREE_LEAVES bounds; beyond that leaves grow. Every vector is
put into the leaf that it reaches by nearest centroids. A query walks the tree with a priority queue of nodes by
nearness, so it meets leaves from the likeliest on. How many leaves it visits is widened until CALIBRATION queries,
whose true neighbours are found by brute force over all vectors, reach TARGET recall, and further for a query whose
leaves hold too few candidates. Queries and vectors meet by twig, the leaves below one node, in parts of at most about
CHUNK rows and QUERIES queries. Of equal vectors only the k + 1 smallest ids can be among k nearest, so the others need
no place in a leaf. An id with several vectors is one candidate, as near as its nearest vector.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, blocks, cut, table

NEAREST = 5
QUERY_EVERY = 50
SAMPLE_ROWS = 20_000
BRANCHES = 12
LEAF_SAMPLES = 40
LEAF_ROWS, SUB_ROWS, TREE_LEAVES = 4_000, 8_000, 100_000
CHUNK, QUERIES = 20_000, 20_000
CALIBRATION, TARGET = 300, 0.95


def matrix(column: pa.Array) -> np.ndarray:
    """Float vectors of one length as rows of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest part first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b; equal rows get equal values."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class KMeansTree:
    """Node k has centroids[k] of its children and children[k], which are nodes, or leaves as -1 - leaf."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLES, seed: int = 7) -> None:
        self.centroids: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.twigs: list[int] = []  # of each leaf, the node above it
        self.rng = np.random.default_rng(seed)
        self._grow(unit(sample) if len(sample) else np.zeros((1, 1)), branches, leaf_rows, root=True)

    def _grow(self, x: np.ndarray, branches: int, leaf_rows: int, root: bool = False, above: int = 0) -> int:
        if not root and len(x) <= leaf_rows:
            return self._leaf(above)
        centres, own = self._kmeans(x, min(branches, len(x)))
        if not root and len(centres) < 2:
            return self._leaf(above)
        node = len(self.centroids)
        self.centroids.append(centres)
        self.children.append([])
        self.children[node] = [self._grow(x[own == k], branches, leaf_rows, above=node) if len(centres) > 1 else self._leaf(node) for k in range(len(centres))]
        return node

    def _leaf(self, above: int) -> int:
        self.twigs.append(above)
        self.leaves += 1
        return -self.leaves

    def graft(self, leaf: int, other: KMeansTree) -> None:
        """Put another tree in a leaf's place; its first leaf takes the leaf's number, the others new ones."""
        node, above = len(self.centroids), self.twigs[leaf]
        number = [leaf, *range(self.leaves, self.leaves + other.leaves - 1)]
        self.children[above][self.children[above].index(-1 - leaf)] = node
        self.centroids += other.centroids
        self.children += [[node + c if c >= 0 else -1 - number[-1 - c] for c in own] for own in other.children]
        self.twigs[leaf] = node + other.twigs[0]
        self.twigs += [node + t for t in other.twigs[1:]]
        self.leaves += other.leaves - 1

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        centres = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            own = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            held = np.unique(own)
            norm = np.linalg.norm(sums[held], axis=1, keepdims=True)
            centres = np.where(norm > 1e-12, sums[held] / np.maximum(norm, 1e-12), centres[held])
        own = np.argmax(x @ centres.T, axis=1)
        held, own = np.unique(own, return_inverse=True)
        return centres[held], own

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out = np.empty(len(x), np.int64)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            own = np.argmax(x[rows] @ self.centroids[node].T, axis=1)
            for k, child in enumerate(self.children[node]):
                part = rows[own == k]
                if len(part):
                    if child < 0:
                        out[part] = -1 - child
                    else:
                        open_.append((child, part))
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves from the most promising on."""
        queue: list[tuple[float, int]] = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for near, child in zip((self.centroids[node] @ q).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-near, child))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding), each once, of vectors that take part: of the table's most frequent length (of equally frequent ones the
    shorter), finite, and not all zero."""
    fine = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    ).select("vec_id", "embedding").distinct()
    sizes = fine.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    return fine if len(sizes) < 2 else fine.filter(F.size("embedding") == sizes[0].d)


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k nearest ids of x: a quick pass finds who can be among them, an exact one ranks these.

    An id with several rows counts once, by its nearest. allowed says for each query and row whether the query asks for the row.
    """
    out, u, v = [], unit(x), unit(q)
    by_id = np.argsort(ids, kind="stable")
    begins = np.flatnonzero(np.append(True, ids[by_id][1:] != ids[by_id][:-1])) if len(ids) else np.zeros(0, int)
    step = max(1, 4_000_000 // max(1, len(x)))
    for at in range(0, len(q), step):  # bounds the matrix
        near = v[at : at + step] @ u.T
        near[query_ids[at : at + step, None] == ids] = -np.inf
        if allowed is not None:
            near[~allowed[at : at + step]] = -np.inf
        of_id = near if len(begins) == len(ids) else np.maximum.reduceat(near[:, by_id], begins, axis=1)
        n = of_id.shape[1]
        worst = np.partition(of_id, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
        who, row = np.nonzero((near >= worst[:, None] - 1e-9) & (near > -np.inf))
        who += at
        score = exact_cosine(q[who], x[row])
        if len(begins) < len(ids):
            order = np.lexsort((-score, ids[row], who))
            who, row, score = who[order], row[order], score[order]
            again = np.append(False, (who[1:] == who[:-1]) & (ids[row][1:] == ids[row][:-1])) if len(who) else np.zeros(0, bool)
            who, row, score = who[~again], row[~again], score[~again]
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        first = np.searchsorted(who, who)  # where the query's rows begin
        kept = np.arange(len(who)) - first < k
        out.append((who[kept], row[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def together(batches: Iterator[pa.RecordBatch], rows: int = 8_192) -> Iterator[pa.RecordBatch]:
    """Batches joined to some thousands of rows, for which a product of matrices pays."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def true_neighbours(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, embedding) by brute force for a bounded list of queries."""
    sent = vectors.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = np.array([i for i, _ in sent.value]), np.array([v for _, v in sent.value], np.float64)
        for batch in together(batches):
            ids = batch.column("vec_id").to_numpy()
            who, row, score = best_of(ids, matrix(batch.column("embedding")), query_ids, q, k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(ids[row]), pa.array(score), batch.column("embedding").take(pa.array(row))], names=["query_id", "vec_id", "score", "embedding"])

    kind = dict(vectors.dtypes)["embedding"]
    found = vectors.mapInArrow(search, f"query_id long, vec_id long, score double, embedding {kind}")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max_by("embedding", "score").alias("embedding"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Index:
    tree: KMeansTree
    counts: dict[int, int]
    visits: int
    placed: DataFrame

    def leaves_of(self, q: np.ndarray, k: int) -> list[int]:
        """The leaves that a query of length one visits."""
        return _visited(self.tree, q, self.counts, self.visits, k)


def _in_leaves(vectors: DataFrame, tree: KMeansTree) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def leaf(batch: pa.RecordBatch) -> dict[str, object]:
        return {"leaf": sent.value.assign(unit(matrix(batch.column("embedding")))) if batch.num_rows else []}

    return cut(arrow_map(vectors, leaf, "leaf long", ["vec_id", "embedding"]))


def build_index(vectors: DataFrame, k: int = NEAREST, target: float = TARGET) -> Index | None:
    """The tree, its leaves' rows, and how many leaves a query visits; None without vectors. vectors is what usable() gives."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    if not sample:
        return None
    tree = KMeansTree(np.array([r.embedding for r in sample], np.float64))
    same = W.partitionBy("embedding").orderBy("vec_id")
    kept = vectors.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")
    placed = _in_leaves(kept, tree)
    large = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_ROWS)  # fewer than leaves
    if not large.isEmpty():
        room = max(LEAF_SAMPLES, SUB_ROWS * min(1.0, TREE_LEAVES / (tree.leaves * SUB_ROWS / LEAF_SAMPLES)))

        def fit(key: tuple, rows: pa.Table) -> pa.Table:
            own = KMeansTree(matrix(rows.column("embedding").combine_chunks()), seed=key[0].as_py())
            return pa.table({"leaf": [key[0].as_py()], "tree": [pickle.dumps(own)]}, pa.schema([("leaf", pa.int64()), ("tree", pa.binary())]))

        chance = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
        some = placed.join(F.broadcast(large.withColumn("share", F.lit(room) / F.col("n"))), "leaf").filter(chance).select("leaf", "embedding")
        for r in some.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary").toLocalIterator():
            tree.graft(r.leaf, pickle.loads(r.tree))
        placed = _in_leaves(kept, tree)
    counts = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as leaves
    return Index(tree, counts, _calibrate(vectors, sample, tree, counts, k, target), placed)


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each vec_id that is divisible by every.

    A vec_id is one query and one candidate, however many rows it has: repeated rows count once, and of several vectors the
    nearest pair of a query's and a candidate's counts. No row is a neighbour of its own vec_id. Equal scores stand by the
    smaller vec_id. Vectors that are null, zero, hold a null or a non-finite component, or aren't of the table's most
    frequent length (of equally frequent lengths the shorter counts) take no part; an empty table gives no rows; fewer
    candidates than k are all returned, and a query whose leaves held fewer ids is answered by brute force. Floats and
    doubles are scored as they are, other numbers as doubles. Other columns are not read, whatever they are called.
    """
    kind = dict(vectors.dtypes)["embedding"]
    own = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    vectors = cut(usable(vectors.select("vec_id", own.alias("embedding"))))
    spark, index = vectors.sparkSession, build_index(vectors, k, target)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast((index.tree, index.counts, index.visits))

    def route(batch: pa.RecordBatch) -> dict[str, object]:
        tree, counts, visits = sent.value
        out = []
        for q in unit(matrix(batch.column("embedding"))) if batch.num_rows else []:
            twigs: dict[int, list[int]] = {}
            for leaf in _visited(tree, q, counts, visits, k):
                twigs.setdefault(tree.twigs[leaf], []).append(leaf)
            out.append([{"twig": t, "leaves": own} for t, own in twigs.items()])
        return {"asked": out}

    def twig(batch: pa.RecordBatch) -> dict[str, object]:
        return {"twig": np.array(sent.value[0].twigs, np.int64)[batch.column("leaf").to_numpy()]}

    queries = vectors.filter(F.col("vec_id") % every == 0)
    routed = arrow_map(queries, route, "asked array<struct<twig:long,leaves:array<long>>>", ["vec_id", "embedding"])
    asked = cut(routed.select(F.col("vec_id").alias("query_id"), "embedding", F.inline("asked")))
    held = cut(arrow_map(index.placed, twig, "twig long", ["vec_id", "embedding", "leaf"]))
    # parts of a twig: as many rows as the tree has nodes at most
    parts = lambda df, out, most: df.groupBy("twig").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(out))
    sizes = F.broadcast(cut(parts(held, "chunks", CHUNK).join(parts(asked, "lots", QUERIES), "twig")))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(sizes, "twig").withColumn("lot", dealt("query_id", "lots")).withColumn("chunk", every_one("chunks")).select("query_id", "embedding", "leaves", "twig", "lot", "chunk")
    held = held.join(sizes, "twig").withColumn("chunk", dealt("vec_id", "chunks")).withColumn("lot", every_one("lots")).select("vec_id", "embedding", "leaf", "twig", "lot", "chunk")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy()
        leaves, place = np.unique(right.column("leaf").to_numpy(), return_inverse=True)
        wanted = np.zeros((len(query_ids), len(leaves)), bool)
        of = left.column("leaves").combine_chunks()
        flat, who = of.flatten().to_numpy(), np.repeat(np.arange(len(query_ids)), np.diff(of.offsets.to_numpy()))
        at = np.searchsorted(leaves, flat)
        here = (at < len(leaves)) & (leaves[np.minimum(at, len(leaves) - 1)] == flat)
        wanted[who[here], at[here]] = True
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        x, q = matrix(right.column("embedding").combine_chunks()), matrix(left.column("embedding").combine_chunks())
        step = max(1, 4_000_000 // len(ids))
        for a in range(0, len(q), step):
            who, row, score = best_of(ids, x, query_ids[a : a + step], q[a : a + step], k, wanted[a : a + step][:, place])
            found = [np.concatenate([f, new]) for f, new in zip(found, (query_ids[a : a + step][who], ids[row], score), strict=True)]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2])})

    met = asked.groupBy("twig", "lot", "chunk").cogroup(held.groupBy("twig", "lot", "chunk")).applyInArrow(search, "query_id long, vec_id long, score double")
    found = cut(_ranked(met, k))
    fewer = min(k, vectors.select("vec_id").distinct().limit(k + 1).count() - 1)
    answered = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewer).select(F.col("query_id").alias("vec_id"))
    for block in blocks(queries.join(answered, "vec_id", "left_anti"), lambda r: 1, CALIBRATION):
        more = true_neighbours(vectors, [(r.vec_id, [float(v) for v in r.embedding]) for r in block], k)
        found = found.unionByName(more.select("query_id", "rank", "vec_id", "score"))
    return _ranked(found, k)


def _ranked(met: DataFrame, k: int) -> DataFrame:
    """The k best ids of each query, each by its best score."""
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visited(tree: KMeansTree, q: np.ndarray, counts: dict[int, int], visits: int, k: int) -> list[int]:
    out, held = [], 0
    for leaf in tree.best_first(q):
        if leaf in counts:
            out.append(leaf)
            held += counts[leaf]
            if len(out) >= visits and held > 2 * k:
                break
    return out


def _calibrate(vectors: DataFrame, sample: list, tree: KMeansTree, counts: dict[int, int], k: int, target: float) -> int:
    """Leaf visits at which the calibration queries' true neighbours are met at the target share."""
    queries = list({r.vec_id: [float(v) for v in r.embedding] for r in sample[:CALIBRATION]}.items())
    truth: dict[int, list] = {}
    for r in true_neighbours(vectors, queries, k).collect():  # CALIBRATION * k rows
        truth.setdefault(r.query_id, []).append(r.embedding)
    needed = []
    for i, q in queries:
        if i in truth:
            place = {leaf: n for n, leaf in enumerate(x for x in tree.best_first(unit(np.array([q]))[0]) if x in counts)}
            needed += [place[int(at)] + 1 for at in tree.assign(unit(np.array(truth[i], np.float64)))]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] if needed else 1


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found for each stated query of the embeddings table."""
    return nearest(table(spark, sf_dir, "embeddings"))
