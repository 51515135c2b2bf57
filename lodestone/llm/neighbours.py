"""Approximate nearest neighbours: low-dimensional stable projections, indexed by kd-trees.

Vectors are projected onto ``PROJECTED`` Gaussian directions (2-stable, so a projected distance is a true distance times a
chi variable).  A kd-tree over the projections, its upper levels fitted on a bounded sample, cuts space
into cells; a cell of many vectors is dealt into blocks.  Every vector is in one block, and every block has a
kd-tree of its own.  A query takes a block's vectors in the order of their projected distance and verifies
them on the original vectors, a few first, then four times as many at each turn.  It stops when the chi-square test holds: a
vector nearer than the k-th found so far would have had a projected distance below the present one with probability
``CONFIDENCE``.

The walk over blocks is distributed in rounds.  A query goes to the block it lies in, then to the blocks next by the distance
of their boxes, up to ``WIDEN`` times as many in a round as before; so the rounds number the logarithm of the blocks.  After each round its k-th
distance so far is known, and with that bound the same test rules out whole blocks, leaves of a block's tree and vectors.  No
number of candidates is a bound: only the test ends a walk.

A block meets its queries in packs of ``PACK`` rows, and where there are more than ``LANE`` queries, in lanes with a copy of the block
each, so neither a task's memory nor its work grows with the number of queries.  The projected distances of a pack are one matrix product.

What is left is quadratic: on data whose distances are concentrated (the 1,000th neighbour hardly farther than the 10th) boxes of
a few thousand vectors rule out little, and each query meets most blocks; the README has the figures.

Vectors that are null, zero, or hold null or non-finite components take no part, neither do rows with a null id and
vectors that have another length than the most frequent one (on a tie the smaller).  Rows are told apart by a number of their own: a query
never finds its own row, but every other row, those that share its id or its vector too; rows that share an id are
separate queries with a list of ranks each, and separate candidates.  Ties go to the smaller id.  With fewer than k candidates all
are found.  An empty table gives an empty table.  Columns other than the id and the vector are not carried over.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import group_starts, whole_groups, written

PROJECTED = 24
CONFIDENCE = 0.9
#: Rows that fit the upper levels of the tree, the first by a hash of their id; more levels than this are never fitted.
SAMPLE, MOST_LEVELS = 16_384, 10
BLOCK_ROWS = 4096
LEAF = 64
#: Projected neighbours verified at a query's first turn in a block.
STEP = 128
#: How many times as many blocks as before a round adds.
WIDEN = 16
#: Queries that a block answers at a time, and those that one copy of a block answers.
PACK, LANE = 1024, 65_536


def chi_square(x: float, freedom: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(freedom // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def stop_ratio(confidence: float, freedom: int) -> float:
    """The projected distance, over a true distance, at which the stopping test starts to hold."""
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < confidence:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < confidence else (low, mid)
    return math.sqrt(high)


@dataclass
class Cells:
    """Upper levels of the tree: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``; the leaves are the cells."""

    directions: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    levels: int

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        rows = np.arange(len(projected))
        for _ in range(self.levels):
            node = 2 * node + 1 + (projected[rows, self.axis[node]] > self.cut[node])
        return node - ((1 << self.levels) - 1)


def fit(sample: np.ndarray, levels: int, projected: int = PROJECTED, seed: int = 5) -> Cells:
    directions = np.random.default_rng(seed).normal(size=(sample.shape[1], projected))
    inner = (1 << levels) - 1
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    parts = {0: sample @ directions}
    for node in range(inner):
        own = parts.pop(node)
        if len(own):
            axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            cut[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] > cut[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return Cells(directions, axis, cut, levels)


class Block:
    """Vectors of one block under a kd-tree over their projections."""

    def __init__(self, num: np.ndarray, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        parts, leaves = [np.arange(len(ids))], []
        while parts:
            own = parts.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            axis = np.argmax(np.ptp(projected[own], axis=0))
            halves = own[np.argpartition(projected[own, axis], len(own) // 2)]
            parts += [halves[: len(own) // 2], halves[len(own) // 2 :]]
        order = np.concatenate(leaves)
        self.num, self.ids, self.vectors, self.projected = num[order], ids[order], vectors[order], projected[order]
        start = np.cumsum([0, *map(len, leaves)])[:-1]
        self.leaf = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        self.low, self.high = np.minimum.reduceat(self.projected, start), np.maximum.reduceat(self.projected, start)
        self.length = (self.projected**2).sum(axis=1)

    def answer(self, own: np.ndarray, queries: np.ndarray, at: np.ndarray, bounds: np.ndarray, k: int, ratio: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows, and their distances, of the ``k`` nearest found; ``bounds``: k-th distances that are known already."""
        slack = 1e-6 * (1 + np.abs(at).sum(axis=1))
        wanted = box_distance(at, self.low, self.high) <= (ratio * bounds + slack)[:, None]
        rows = np.flatnonzero(wanted.any(axis=0)[self.leaf])
        far = self.length[rows] - 2 * at @ self.projected[rows].T + (at**2).sum(axis=1)[:, None]
        far = np.sqrt(np.maximum(far, 0))
        far[self.num[rows] == own[:, None]] = np.inf  # its own row
        return [self._walk(rows, f, q, k, b, ratio, s) for f, q, b, s in zip(far, queries, bounds.tolist(), slack.tolist(), strict=True)]

    def _walk(self, rows: np.ndarray, far: np.ndarray, query: np.ndarray, k: int, bound: float, ratio: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
        best, dist = np.empty(0, np.int64), np.empty(0)
        left, step = np.flatnonzero(far < np.inf), STEP
        while True:
            left = left[far[left] <= ratio * bound + slack]
            if not len(left):
                return best, dist
            if len(left) > step:
                split = np.argpartition(far[left], step)
                now, left, step = left[split[:step]], left[split[step:]], 4 * step
            else:
                now, left = left, left[:0]
            away = self.vectors[rows[now]] - query
            found = np.sqrt((away * away).sum(axis=1))
            near = found <= bound
            best, dist = np.append(best, rows[now[near]]), np.append(dist, found[near])
            first = np.lexsort((self.ids[best], dist))[:k]
            best, dist = best[first], dist[first]
            if len(best) == k:
                bound = min(bound, float(dist[-1]))


def box_distance(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Points x boxes: how far a point is from a box."""
    out = np.zeros((len(at), len(low)))
    for axis in range(at.shape[1]):
        x = at[:, axis, None]
        gap = np.maximum(np.maximum(low[:, axis] - x, x - high[:, axis]), 0)
        out += gap * gap
    return np.sqrt(out)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


_FOUND = ["num", "query_id", "row", "id", "score"]


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    confidence: float = CONFIDENCE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` (the distance) of the ``k`` nearest of each row that ``is_query`` marks.

    ``is_query`` is a condition on the id, which is an integer."""
    spark = vectors.sparkSession
    item = vectors.schema[vec_col].dataType.elementType
    item = "float" if item.simpleString() == "float" else "double"  # float components stay as short as they are
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{item}>").alias("vector"))
    usable = usable.filter(F.col("id").isNotNull() & _usable(F.col("vector")))
    lengths = usable.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    length, total = (lengths[0]["length"], lengths[0]["count"]) if lengths else (1, 0)
    usable = usable.filter(F.size("vector") == length)
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(1, total) / block_rows))))
    # a bounded number of rows
    sample = usable.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).select("vector").collect()
    cells = fit(np.array([r["vector"] for r in sample], float).reshape(-1, length), levels)
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                projected = shared.value.project(_matrix(batch.column(1)))
                own = np.arange(num, num + batch.num_rows)
                num += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), *batch.columns, pa.array(shared.value.of(projected)), _lists(projected)], names=["num", "id", "vector", "cell", "projected"]
                )

    placed = written(spark, usable.mapInArrow(place, f"num long, id long, vector array<{item}>, cell long, projected array<double>"), "ann-placed")
    # a row for each cell, 2^MOST_LEVELS at most
    sides = [f(F.col("projected")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    measures = [F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("id"))).alias("asked"), *sides]
    boxes = sorted(placed.groupBy("cell").agg(*measures).collect(), key=lambda r: r["cell"])
    low, high = (np.array([[r[f"{n}{i}"] for i in range(PROJECTED)] for r in boxes]).reshape(-1, PROJECTED) for n in ("low", "high"))
    parts = np.array([math.ceil(r["n"] / block_rows) for r in boxes], np.int64)
    named = np.repeat(np.array([r["cell"] for r in boxes], np.int64) << 32, parts) + np.concatenate([np.arange(0), *map(np.arange, parts)])
    ratio = stop_ratio(confidence, PROJECTED)
    layout = spark.sparkContext.broadcast((named, parts, low, high))

    in_cell = [1] * (1 << levels)
    for r, n in zip(boxes, parts.tolist(), strict=True):
        in_cell[r["cell"]] = n
    part = F.pmod(F.xxhash64("num"), F.get(F.array(*map(F.lit, in_cell)), F.col("cell").cast("int")))
    own_block = (F.col("cell") * (1 << 32) + part).alias("block")
    n_asked = sum(r["asked"] for r in boxes)
    lanes, packs = max(1, math.ceil(n_asked / LANE)), max(1, math.ceil(n_asked / PACK))
    pack = F.pmod(F.xxhash64(F.col("num") + 1), F.lit(packs)) + 1
    rows = placed.select(own_block, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).cast("long").alias("turn"), "num", "id", "vector", F.lit(0.0).alias("bound"))
    asked = placed.filter(is_query(F.col("id"))).select(own_block, "num", F.col("id").alias("query_id"), "vector")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = None, None
        # a block's rows come first, and together; its queries follow, a pack at a time
        for table in whole_groups(batches, ["block", "lane", "turn"]):
            names, turns = table["block"].to_numpy(), table["turn"].to_numpy()
            cuts = group_starts(names, table["lane"].to_numpy(), turns).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                group = table.slice(a, b - a).combine_chunks()
                num, vectors = group["num"].to_numpy(), _matrix(group["vector"].chunk(0))
                projected = shared.value.project(vectors)
                if turns[a] == 0:
                    name, block = names[a], Block(num, group["id"].to_numpy(), vectors, projected)
                    continue
                if name != names[a]:
                    raise ValueError("a block has no rows")
                for x in range(0, len(num), PACK):
                    y = slice(x, x + PACK)
                    found = block.answer(num[y], vectors[y], projected[y], group["bound"].to_numpy()[y], k, ratio)
                    counts = [len(r) for r, _ in found]
                    at = np.concatenate([r for r, _ in found])
                    columns = [np.repeat(num[y], counts), np.repeat(group["id"].to_numpy()[y], counts), block.num[at], block.ids[at]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([d for _, d in found]))], names=_FOUND)

    def route(first: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Sends a query to those of its blocks, by their boxes' distance, that are in places ``first`` to ``end``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, counts, bottom, top = layout.value
            for batch in batches:
                for x in range(0, batch.num_rows, PACK):
                    some = batch.slice(x, PACK)
                    at = shared.value.project(_matrix(some.column(3)))
                    near = np.repeat(box_distance(at, bottom, top), counts, axis=1)
                    reach = ratio * some.column(4).to_numpy() + 1e-6 * (1 + np.abs(at).sum(axis=1))
                    sort_by = np.where(names == some.column(0).to_numpy()[:, None], -1.0, near)  # its own block comes first
                    chosen = np.argsort(sort_by, axis=1, kind="stable")[:, first:end]
                    query, place = np.nonzero(np.take_along_axis(near, chosen, axis=1) <= reach[:, None])
                    if len(query):
                        goes = pa.array(names[chosen[query, place]])
                        yield pa.RecordBatch.from_arrays([goes, *(c.take(pa.array(query)) for c in some.columns[1:])], names=["block", "num", "id", "vector", "bound"])

        return run

    def answers(queries: DataFrame, first: int, end: int) -> DataFrame:
        sent = queries.mapInArrow(route(first, end), f"block long, num long, id long, vector array<{item}>, bound double")
        lane = F.pmod(F.xxhash64(F.col("num") + 2), F.lit(lanes)).cast("int").alias("lane")
        dealt = rows.union(sent.select("block", lane, pack.alias("turn"), "num", "id", "vector", "bound"))
        dealt = dealt.repartition("block", "lane").sortWithinPartitions("block", "lane", "turn")
        return dealt.mapInArrow(answer, "num long, query_id long, row long, id long, score double")

    best = Window.partitionBy("num").orderBy("score", "id", "row")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found, first, end = None, 0, 1
    while found is None or first < len(named):
        bound = F.lit(math.inf)
        queries = asked
        if found is not None:
            known = found.groupBy("num").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))
            queries, bound = asked.join(known, "num", "left"), F.coalesce("bound", F.lit(math.inf))
        new = answers(queries.select("block", "num", "query_id", "vector", bound.alias("bound")), first, end)
        found = ranked(new if found is None else new.union(found.drop("rank")))
        first, end = end, end * WIDEN
        if first < len(named):
            found = written(spark, found, "ann-found")
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
