"""A metric index of vectors: exact nearest neighbours and exact joins within a distance, by pivots.

Vectors of length one lie in a metric space, so what is near a vector is near it in its distances to pivots too. Each
vector is dealt to the cell of its nearest pivot and, in it, to a ring of distances to that pivot. A search knows from a
ring's least and greatest distance, and from the plane between two pivots, how near any of its vectors can be, and
visits no ring that can't hold what it looks for. Only where all rings may, as with vectors without any clusters, does it
compare all pairs. Searching vectors travel by shuffle, once to each block of cells with a ring for them, since a row for
each ring would carry a vector thousands of times; in the block they meet, cell by cell, what is at a fit distance to its
pivot. What is sent to tasks are the pivots and the rings' bounds, PIVOTS x RINGS rows at most. Large blocks are split into
parts, and so are many visitors of one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .tables import written

#: Pivots at most, the vectors they are chosen from, and the rings of a cell.
PIVOTS, SAMPLE, RINGS = 512, 8_192, 32
#: Vectors of one part of a ring, and visitors that meet it at once.
PART, VISITORS = 16_384, 16_384
#: Vectors of the small cells that one visit takes together, and bounds to rings that a task works out at once.
BLOCK, ROUTED = 4_096, 1_000_000
#: Distances are compared as they are rounded, to so many places.
PLACES = 6
#: Further than any two vectors of length one.
FAR = 2.1
SLACK = 1e-7
#: The cell of vectors of length zero, which are at distance 1 from everything.
ZERO = -1


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Straight distances between vectors of length one."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def reach(cosine_distance: np.ndarray | float) -> np.ndarray | float:
    """The straight distance within which everything lies that is at this cosine distance when rounded."""
    return np.sqrt(2 * np.maximum(0.0, cosine_distance + 1.0 * 10**-PLACES)) + SLACK


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Of the sample, one vector after the other that is farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, near = [0], apart(sample, sample[:1])[:, 0]
    while len(chosen) < min(most, len(sample)):
        far = int(near.argmax())
        if near[far] <= 1e-6:
            break
        chosen.append(far)
        near = np.minimum(near, apart(sample, sample[far : far + 1])[:, 0])
    return sample[chosen]


@dataclass(frozen=True)
class Bounds:
    """What tasks know of an index: pivots and, for each ring that has vectors, its cell, number, rows, least and greatest distance."""

    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of vectors of length one or zero."""
        if not len(self.pivots):
            return np.full(len(x), ZERO), np.zeros(len(x))
        far = apart(x, self.pivots)
        cell = far.argmin(axis=1)
        zero = ~x.any(axis=1)
        return np.where(zero, ZERO, cell), np.where(zero, 0.0, far[np.arange(len(x)), cell])

    def least(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least straight distance to anything in each ring, distance to the ring's pivot), a row for each vector."""
        n = len(self.cell)
        if not len(self.pivots):
            return np.zeros((len(x), n)), np.zeros((len(x), n))
        far = apart(x, self.pivots)
        own = far[:, np.maximum(self.cell, 0)]
        bound = np.maximum(np.maximum(self.low - own, own - self.high), 0.0)
        home = far.argmin(axis=1)
        # what is in a cell lies on its side of the plane between its pivot and the visitor's
        between = apart(self.pivots, self.pivots)[home][:, np.maximum(self.cell, 0)]
        nearest = far[np.arange(len(x)), home][:, None]
        plane = np.divide(own**2 - nearest**2, 2 * between, out=np.zeros_like(own), where=between > 1e-9)
        bound = np.maximum(bound, plane)
        bound[:, self.cell == ZERO] = math.sqrt(2)
        bound[~x.any(axis=1)] = 0.0  # a zero vector is as far from everything
        return np.maximum(bound - SLACK, 0.0), own

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first ring of each cell, its block, its rows); rings stand by cell."""
        if not len(self.cell):
            return (np.zeros(0, np.int64),) * 3
        first = np.flatnonzero(np.r_[True, self.cell[1:] != self.cell[:-1]])
        rows = np.add.reduceat(self.rows, first)
        return first, (np.cumsum(rows) - rows) // BLOCK, rows


@dataclass(frozen=True)
class Index:
    bounds: Bounds
    placed: DataFrame  # id, unit, cell, ring, far and the columns that were asked to stay


def _arrow(df: DataFrame, fn, added: str, keep: list[str]) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(added)])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema, timestamp_utc=True)
    new = {f.name for f in T._parse_datatype_string(added)}

    def run(batches):
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in new else batch.column(f.name) for f in target], names=target.names)

    return df.mapInArrow(run, schema)


def _lists(x: np.ndarray) -> pa.Array:
    width = x.shape[1] if x.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))


def build(vectors: DataFrame, keep: list[str] | None = None) -> Index:
    """An index of vectors (id, embedding: numbers of one size). Rows without a vector have no place in it.

    Pivots are as many as half the root of the number of rows, PIVOTS at most, chosen from SAMPLE rows far from each other.
    """
    spark, keep = vectors.sparkSession, list(keep or [])
    held = vectors.filter("embedding is not null").select("id", "embedding", *keep)
    sample = held.select("embedding").orderBy(F.xxhash64("id"), F.xxhash64("embedding")).limit(SAMPLE).collect()
    n = held.count()
    usable = units(np.array([r.embedding for r in sample], np.float64)) if sample else np.zeros((0, 0))
    usable = usable[usable.any(axis=1)] if len(usable) else usable
    pivots = choose_pivots(usable, min(PIVOTS, max(4, math.isqrt(n) // 2)))
    none = np.zeros(0)
    sent = spark.sparkContext.broadcast(Bounds(pivots, none, none, none, none, none))

    def place(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = units(matrix(batch.column("embedding")))
        cell, far = sent.value.nearest(x) if len(x) else (none, none)
        ring = np.minimum((far * RINGS / 2).astype(np.int64), RINGS - 1)
        return {"unit": _lists(x), "cell": pa.array(cell), "ring": pa.array(ring), "far": pa.array(far)}

    placed = written(_arrow(held, place, "unit array<double>, cell int, ring int, far double", ["id", *keep]))
    rings = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("cell", "ring").collect()  # PIVOTS x RINGS rows at most
    column = lambda name, kind: np.array([r[name] for r in rings], kind)
    bounds = Bounds(pivots, column("cell", np.int64), column("ring", np.int64), column("n", np.int64), column("low", float), column("high", float))
    return Index(bounds, placed)


def _met(index: Index, visitors: DataFrame, found, schema: str, extra: list[str]) -> DataFrame:
    """found(visitors, residents) for every part of a block and each lot of its visitors (visitor columns, blocks: array of block, cells)."""
    spark, bounds = index.placed.sparkSession, index.bounds
    asked = written(visitors.withColumn("_v", F.xxhash64(*extra[:1])).withColumn("b", F.explode("blocks")).select(*extra, "_v", "b.*"))
    first, block, rows = bounds.blocks()
    held = {int(b): int(rows[block == b].sum()) for b in np.unique(block)}
    parts = spark.createDataFrame([(b, -(-n // PART)) for b, n in held.items()], "block int, parts int")
    cells = spark.createDataFrame([(int(c), int(b)) for c, b in zip(bounds.cell[first], block, strict=True)], "cell int, block int")
    lots = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("lots"))
    blocks = F.broadcast(written(parts.join(lots, "block")))  # PIVOTS rows at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, "block").withColumn("lot", F.pmod("_v", "lots").cast("int")).withColumn("part", each("parts")).drop("_v", "lots", "parts")
    placed = index.placed.join(F.broadcast(cells), "cell").join(blocks, "block")
    right = placed.withColumn("part", F.pmod(F.xxhash64("id", "unit"), F.col("parts")).cast("int")).withColumn("lot", each("lots")).drop("lots", "parts")
    keys = ["block", "part", "lot"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(found, schema)


def _cells(bounds: Bounds, marked: np.ndarray) -> np.ndarray:
    """Which cells hold a marked ring, a row for each vector."""
    return np.logical_or.reduceat(marked, bounds.blocks()[0], axis=1)


def _routed(index: Index, visitors: DataFrame, keep: list[str], which) -> DataFrame:
    """visitors (unit and kept columns) with blocks: of each the cells that which(bounds, batch, least) marks and the own distance to their pivots."""
    sent = visitors.sparkSession.sparkContext.broadcast(index.bounds)
    pair = pa.struct([("cell", pa.int32()), ("own", pa.float64())])
    kind = pa.struct([("block", pa.int32()), ("cells", pa.list_(pair))])

    def some(bounds: Bounds, batch: pa.RecordBatch) -> pa.Array:
        x = matrix(batch.column("unit"))
        if not len(x) or not len(bounds.cell):
            return pa.array([[]] * len(x), pa.list_(kind))
        first, block, _ = bounds.blocks()
        least, own = bounds.least(x)
        row, cell = np.nonzero(which(bounds, batch, least))
        pairs = pa.StructArray.from_arrays([pa.array(bounds.cell[first][cell], pa.int32()), pa.array(own[row, first[cell]])], names=["cell", "own"])
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[cell[1:]] != block[cell[:-1]])]) if len(row) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pairs)
        made = pa.StructArray.from_arrays([pa.array(block[cell[starts]], pa.int32()), lists], names=["block", "cells"])
        at = np.concatenate([[0], np.cumsum(np.bincount(row[starts], minlength=len(x)))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), made).cast(pa.list_(kind))

    def route(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bounds = sent.value
        step = max(1, ROUTED // max(1, len(bounds.cell)))
        return {"blocks": pa.concat_arrays([some(bounds, batch.slice(at, step)) for at in range(0, max(1, batch.num_rows), step)])}

    return _arrow(visitors, route, "blocks array<struct<block:int,cells:array<struct<cell:int,own:double>>>>", keep)


def nearest(vectors: DataFrame | Index, queries: DataFrame, k: int, exclude_self: bool = False, compared: Accumulator | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of vectors (id, embedding) by cosine for each of queries (query_id, embedding).

    Exact, for any number of queries. Distances are rounded to PLACES, ties stand by id. A zero vector is at distance 1 from
    everything; rows and queries without a vector take no part. Repeated rows are rows of their own, and queries that repeat
    an id are one query. With exclude_self, rows whose id is the query's don't count. compared, an accumulator, counts the
    distances that were computed.

    Each query first meets the cells of the nearest rings that hold enough rows; the k-th distance there says which further
    rings can hold a nearer row, and so which cells it meets.
    """
    index = vectors if isinstance(vectors, Index) else build(vectors)
    spark = queries.sparkSession
    kinds = dict(index.placed.dtypes)["id"], dict(queries.dtypes)["query_id"]
    asked = queries.filter("embedding is not null").select("query_id", "embedding").dropDuplicates(["query_id"])
    asked = written(_arrow(asked, lambda b: {"unit": _lists(units(matrix(b.column("embedding"))))}, "unit array<double>", ["query_id"]))
    enough = k + int(exclude_self)

    def home(bounds: Bounds, batch: pa.RecordBatch, least: np.ndarray) -> np.ndarray:
        order = np.argsort(least, axis=1, kind="stable")
        before = np.cumsum(bounds.rows[order], axis=1) - bounds.rows[order]
        out = np.zeros(least.shape, bool)
        np.put_along_axis(out, order, before < enough, axis=1)
        return _cells(bounds, out)

    keep = ["query_id", "unit", "limit"]
    near = _routed(index, asked.withColumn("limit", F.lit(FAR)), keep, home)
    schema = f"query_id {kinds[1]}, id {kinds[0]}, distance double"
    search = _searcher(k, exclude_self, compared, spark, schema)
    first = written(top(_met(index, near, search, schema, keep), k))
    worst = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst"))
    limit = F.when(F.col("n") >= k, F.sqrt(2 * F.greatest(F.lit(0.0), F.col("worst") + 10.0**-PLACES)) + SLACK).otherwise(F.lit(FAR))
    again = asked.join(worst, "query_id", "left").select("query_id", "unit", F.coalesce(limit, F.lit(FAR)).alias("limit"))

    def further(bounds: Bounds, batch: pa.RecordBatch, least: np.ndarray) -> np.ndarray:
        return _cells(bounds, least <= batch.column("limit").to_numpy()[:, None]) & ~home(bounds, batch, least)

    rest = _met(index, _routed(index, again, keep, further), search, schema, keep)
    return top(first.drop("rank").unionByName(rest), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query by distance and id, ranked from 1."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _windows(own: np.ndarray, limit: np.ndarray, far: np.ndarray, step: int = 64):
    """Visitors in lots of step, by their distance to the pivot, with the residents (by theirs) that any of them can be near to."""
    by = np.argsort(own, kind="stable")
    for at in range(0, len(by), step):
        rows = by[at : at + step]
        low = np.searchsorted(far, (own[rows] - limit[rows]).min() - SLACK)
        high = np.searchsorted(far, (own[rows] + limit[rows]).max() + SLACK, "right")
        if low < high:
            yield rows, slice(int(low), int(high))


def _meets(left: pa.Table, right: pa.Table, limit: np.ndarray):
    """Visitors in lots with the residents that any of them can be near to, cell by cell; right stands by cell and far."""
    lists = left.column("cells").combine_chunks()
    visitor = np.repeat(np.arange(left.num_rows), lists.value_lengths().to_numpy())
    cell, own = (lists.flatten().field(name).to_numpy() for name in ("cell", "own"))
    of, far = right.column("cell").to_numpy(), right.column("far").to_numpy()
    for c in np.unique(cell):
        low, high = np.searchsorted(of, c), np.searchsorted(of, c, "right")
        if low < high:
            mine = cell == c
            who = visitor[mine]
            reached = np.full(len(who), FAR) if c == ZERO else limit[who]
            for rows, span in _windows(own[mine], reached, far[low:high]):
                yield who[rows], slice(int(low) + span.start, int(low) + span.stop)


def _searcher(k: int, exclude_self: bool, compared: Accumulator | None, spark: SparkSession, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T._parse_datatype_string(schema), timestamp_utc=True)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [target.empty_table()]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("cell", "ascending"), ("far", "ascending")])
            x = matrix(right.column("unit").combine_chunks())
            q, limit = matrix(left.column("unit").combine_chunks()), left.column("limit").to_numpy().copy()
            limit[~q.any(axis=1)] = FAR
            ids, asking = right.column("id").combine_chunks(), left.column("query_id").combine_chunks()
            for rows, span in _meets(left, right, limit):
                distance = np.round(1 - q[rows] @ x[span].T, PLACES) + 0.0
                if compared is not None:
                    compared.add(distance.size)
                if exclude_self:
                    same = np.equal.outer(asking.take(pa.array(rows)).to_numpy(zero_copy_only=False), ids[span.start : span.stop].to_numpy(zero_copy_only=False))
                    distance[same] = np.inf
                worst = np.partition(distance, k - 1, axis=1)[:, k - 1] if distance.shape[1] > k else np.full(len(rows), np.inf)
                a, b = np.nonzero((distance <= worst[:, None]) & np.isfinite(distance))
                found = pa.table([asking.take(pa.array(rows[a])), ids.take(pa.array(b + span.start)), pa.array(distance[a, b])], names=["query_id", "id", "distance"])
                if found.num_rows > k * len(rows):  # many ties: the first k by id stay
                    found = found.append_column("who", pa.array(a)).sort_by([("who", "ascending"), ("distance", "ascending"), ("id", "ascending")])
                    who = found.column("who").to_numpy()
                    found = found.filter(pa.array(np.arange(len(who)) - np.searchsorted(who, who) < k)).drop_columns(["who"])
                out.append(found.cast(target))
        return pa.concat_tables(out)

    return search


def within(vectors: DataFrame, limit: float, compared: Accumulator | None = None) -> DataFrame:
    """(id, class_id, n_links): for every row of vectors (id, embedding), how many others are within the cosine distance limit, under
    1, when rounded to PLACES, and the smallest id that can be reached over such links.

    Equal vectors are compared once: each has all its copies as links. Zero vectors and rows without a vector have no links.
    Ids are distinct. Links are counted where vectors meet and handed on as trees that connect the same rows, so a cloud
    of n near vectors costs its comparisons but not n x n rows.
    """
    if not 0 <= limit < 1:
        raise ValueError("the limit is a cosine distance from 0 to under 1")
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["id"]
    held = written(vectors.select("id", "embedding", F.xxhash64("embedding").alias("_h")))
    nonzero = F.exists("embedding", lambda v: v != 0)
    firsts = held.filter(nonzero).groupBy("_h", "embedding").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = written(firsts.withColumnRenamed("first", "id"))
    index = build(firsts, ["copies"])
    eps = float(reach(limit))
    visitors = _routed(index, index.placed.select("id", "unit", F.lit(eps).alias("limit")), ["id", "unit", "limit"], lambda bounds, batch, least: _cells(bounds, least <= eps))
    met = written(_met(index, visitors, _joiner(limit, compared, kind), f"id {kind}, other {kind}, n long", ["id", "unit", "limit"]))
    links = met.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(met.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    each = firsts.join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    each = written(each.select("_h", "embedding", F.coalesce("root", "id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    back = held.alias("v").join(each.alias("e"), (F.col("v._h") == F.col("e._h")) & (F.col("v.embedding") == F.col("e.embedding")), "left")
    return back.select("v.id", F.coalesce("e.class_id", "v.id").alias("class_id"), F.coalesce("e.n_links", F.lit(0)).cast("long").alias("n_links"))


def _joiner(limit: float, compared: Accumulator | None, kind: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T._parse_datatype_string(f"id {kind}, other {kind}, n long"), timestamp_utc=True)

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        right = right.sort_by([("cell", "ascending"), ("far", "ascending")])
        x = matrix(right.column("unit").combine_chunks())
        q, reached = matrix(left.column("unit").combine_chunks()), left.column("limit").to_numpy()
        names = pa.chunked_array([*left.column("id").chunks, *right.column("id").chunks], target.field("id").type).combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        visitor, resident, copies = code[: len(q)], code[len(q) :], right.column("copies").to_numpy()
        count, root = np.zeros(len(q), np.int64), np.arange(len(names.dictionary))
        for rows, span in _meets(left, right, reached):
            near = np.round(1 - q[rows] @ x[span].T, PLACES) <= limit
            near &= visitor[rows][:, None] != resident[span]
            if compared is not None:
                compared.add(near.size)
            count[rows] += near @ copies[span]
            for a, linked in zip(visitor[rows].tolist(), near, strict=True):
                _tie(root, a, resident[span][linked])
        linked = np.flatnonzero(count)
        top = np.array([_root(root, int(k)) for k in range(len(root))])
        tied = np.flatnonzero(top != np.arange(len(root)))
        ids = pa.concat_arrays([names.dictionary.take(pa.array(visitor[linked])), names.dictionary.take(pa.array(tied))])
        other = pa.concat_arrays([pa.nulls(len(linked), ids.type), names.dictionary.take(pa.array(top[tied]))])
        n = pa.concat_arrays([pa.array(count[linked]), pa.nulls(len(tied), pa.int64())])
        return pa.table([ids, other, n], names=["id", "other", "n"]).cast(target)

    return join


def _root(root: np.ndarray, k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = int(root[k])
    return k


def _tie(root: np.ndarray, a: int, others: np.ndarray) -> None:
    """Put a and others into one tree."""
    if len(others):
        tops = {_root(root, a), *(_root(root, int(b)) for b in np.unique(root[others]))}
        root[list(tops)] = min(tops)
