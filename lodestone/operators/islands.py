"""Searches from many origins, island by island.

An island is a connected part of a graph, whatever the directions of its edges: no search leaves it.  Islands of at most ``LINKS`` edges are searched whole, each in one task with
sets of origins as bits in memory, and what is asked for is written out from there; no step is shuffled.  Larger ones are left to the caller, with their edges and seeds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodestone.operators.storage import written

#: Edges of the largest island that one task holds.
LINKS = 1 << 20
#: Edges of which one task makes a forest at a time.
FOREST = 1 << 21
#: Words of 64 origins that are searched together, and numbers that a step gathers at most, beyond one a link.
WORDS, GATHERED = 8, 1 << 23
#: Rows of a batch, and bits looked at for it.
BATCH, CELLS = 1 << 18, 1 << 20


def _places(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of columns, and each column as places among them."""
    every = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    every = (pa.concat_arrays(every.chunks) if isinstance(every, pa.ChunkedArray) else every).dictionary_encode()
    at = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return every.dictionary, np.split(at, np.cumsum([len(c) for c in columns])[:-1])


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """A root for each of ``n`` nodes, the same for all of a connected part."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that tie together what the given ones do, one a node at most."""

    def tied(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, (u, v) = _places(table["src"], table["dst"])
        root = _roots(u, v, len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch({"src": nodes.take(pa.array(own)), "dst": nodes.take(pa.array(root[own]))})

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= FOREST:
            yield tied(held)
            held, n = [], 0
    if n:
        yield tied(held)


class _Graph:
    """Edges by their starts and by their ends, those of an end in the order of ``rank`` of their starts."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, rank: np.ndarray | None = None):
        self.n, self.links = n, len(src)
        out, into = np.argsort(src, kind="stable"), np.lexsort((src if rank is None else rank[src], dst))
        self.out, self.src = dst[out], src[into]
        self.out_at, self.in_at = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]) for x in (src, dst))
        self.ends = np.flatnonzero(np.diff(self.in_at))

    def step(self, at: np.ndarray, bits: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of edges from the nodes ``at``, and the bits that come there; ``front`` has the same bits by node."""
        each = self.out_at[at + 1] - self.out_at[at]
        total = int(each.sum())
        if total > self.links // 4:
            return self.ends, np.bitwise_or.reduceat(front[self.src], self.in_at[self.ends], axis=0)
        if not total:
            return at[:0], bits[:0]
        begin = np.cumsum(each) - each
        to = self.out[np.arange(total) + np.repeat(self.out_at[at] - begin, each)]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], np.repeat(np.arange(len(at)), each)[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        return to[first], np.bitwise_or.reduceat(bits[frm], first, axis=0)

    def levels(self, seeds: np.ndarray, origins: np.ndarray, words: int, depth: int | None, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Step, nodes, the origins' bits that come there first, and the bits of the step before by node.  ``seen`` fills up."""
        front = np.zeros((self.n, words), np.uint64)
        np.bitwise_or.at(front, (seeds, origins // 64), np.left_shift(np.uint64(1), (origins % 64).astype(np.uint64)))
        at = np.unique(seeds)
        bits, step = front[at], 0
        seen[at] = bits
        yield step, at, bits, front
        while len(at) and (depth is None or step < depth):
            step += 1
            to, moved = self.step(at, bits, front) if self.links else (at[:0], bits[:0])
            moved = moved & ~seen[to]
            new = moved.any(axis=1)
            to, moved = to[new], moved[new]
            seen[to] |= moved
            yield step, to, moved, front
            front[at] = 0
            front[to] = moved
            at, bits = to, moved

    def parents(self, nodes: np.ndarray, bits: np.ndarray, front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes, bits and the first start of an edge that brought them."""
        left, at, end = bits.copy(), self.in_at[nodes], self.in_at[nodes + 1]
        while len(nodes):
            frm = self.src[at]
            met = front[frm] & left
            some = met.any(axis=1)
            yield nodes[some], met[some], frm[some]
            left &= ~met
            at = at + 1
            more = (at < end) & left.any(axis=1)
            nodes, left, at, end = nodes[more], left[more], at[more], end[more]


def _pairs(bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and places of the bits that are set."""
    rows = max(1, CELLS // (64 * bits.shape[1]))
    for k in range(0, len(bits), rows):
        row, place = np.nonzero(np.unpackbits(np.ascontiguousarray(bits[k : k + rows]).astype("<u8").view(np.uint8), axis=1, bitorder="little"))
        yield row + k, place


@dataclass
class Search:
    """``depth``: None for all steps; ``parents``: with the least predecessor on a shortest path.  ``kinds``: None, or categories: then a flow is told from one that has met a stop of its category."""

    depth: int | None = None
    parents: bool = False
    kinds: list[str] | None = None
    targets: bool = False

    def found(self, table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """``node``, ``origin`` (places), ``dist``, ``parent``, ``kind``, ``clean`` of the parts of the answer, after the distinct nodes and origins."""
        of = lambda kind: table.filter(pc.equal(table["kind"], kind))
        links, seeds, stops, targets = (of(k) for k in range(4))
        nodes, (src, dst, start, stop, target) = _places(links["a"], links["b"], seeds["a"], stops["a"], targets["a"])
        origins, (origin,) = _places(seeds["origin"])
        yield nodes, origins
        n, rank = len(nodes), None
        if self.parents:
            rank = np.empty(n, np.int64)
            rank[pc.sort_indices(nodes).to_numpy()] = np.arange(n)
        plain = _Graph(src, dst, n, rank) if self.kinds is None else None
        words = max(1, min(WORDS, GATHERED // max(1, len(src)), -(-len(origins) // 64)))
        for c, _ in enumerate(self.kinds or [None]):
            mine = lambda t, at: at[t["category"].to_numpy() == c] if self.kinds else at  # noqa: B023, E731
            wanted = np.zeros(n, bool) if self.targets else None
            if self.targets:
                wanted[mine(targets, target)] = True
            if self.kinds is not None:
                stopped = np.zeros(n, bool)
                stopped[mine(stops, stop)] = True
                open_ = ~stopped[dst]
                raw = _Graph(src[open_], dst[open_], n)
                # nodes stand twice, for flows that have met a stop and for those that have not
                both = _Graph(np.concatenate([src, src + n]), np.concatenate([dst + n * stopped[dst], dst + n]), 2 * n) if stopped.any() else None
            for k in range(0, len(origins), 64 * words):
                own = (origin >= k) & (origin < k + 64 * words)
                at, place = start[own], origin[own] - k
                graph = plain or raw
                seen = np.zeros((n, words), np.uint64)
                for dist, to, bits, front in graph.levels(at, place, words, self.depth, seen):
                    for ends, some, frm in graph.parents(to, bits, front) if self.parents and dist else [(to, bits, None)]:
                        yield from self._rows(ends, some, wanted, k, dist, frm, c, False)
                if self.kinds is not None and both is not None:
                    for dist, to, bits, _ in both.levels(at, place, words, self.depth, np.zeros((2 * n, words), np.uint64)):
                        late = to >= n
                        ends = to[late] - n
                        yield from self._rows(ends, bits[late] & ~seen[ends], wanted, k, dist, None, c, True)

    def _rows(self, ends, bits, wanted, first, dist, frm, kind, clean):
        if wanted is not None:
            keep = wanted[ends]
            ends, bits, frm = ends[keep], bits[keep], None if frm is None else frm[keep]
        for row, place in _pairs(bits):
            if len(row):
                yield ends[row], place + first, dist, None if frm is None else frm[row], kind, clean

    def answer(self, names: list[str]):
        """For ``applyInArrow``: the rows of one group."""

        def batches(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = self.found(pa.Table.from_batches(list(parts)))
            nodes, origins = next(found)
            held, n = [], 0
            for rows in found:
                held, n = [*held, rows], n + len(rows[0])
                if n >= BATCH:
                    yield from self._batches(held, nodes, origins, names)
                    held, n = [], 0
            if n:
                yield from self._batches(held, nodes, origins, names)

        return batches

    def _batches(self, held, nodes, origins, names) -> Iterator[pa.RecordBatch]:
        many = lambda k, kind: np.concatenate([np.full(len(x[0]), x[k], kind) for x in held])
        node = lambda k: pa.concat_arrays([pa.nulls(len(x[0]), nodes.type) if x[k] is None else nodes.take(pa.array(x[k])) for x in held])
        made = {
            "origin": lambda: origins.take(pa.array(np.concatenate([x[1] for x in held]))), "node": lambda: node(0), "dist": lambda: pa.array(many(2, np.int32)), "parent": lambda: node(3),
            "category": lambda: pa.array(self.kinds, pa.string()).take(pa.array(many(4, np.int64))), "clean": lambda: pa.array(many(5, bool)),
        }
        table = pa.Table.from_arrays([made[x]() for x in names], names=names)
        yield from table.to_batches(max_chunksize=BATCH)


@dataclass
class Precise:
    """For pairs of an origin (a node) and a target, which come as marks: ``worst``, ``length`` and ``path`` of the path with the least worst precision of an edge, then the fewest edges, then the least nodes from the target back."""

    def answer(self, names: list[str]):
        def batches(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from self._found(pa.Table.from_batches(list(parts)), names)

        return batches

    def _found(self, table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
        links, seeds, pairs = (table.filter(pc.equal(table["kind"], k)) for k in range(3))
        nodes, (src, dst, start, target) = _places(links["a"], links["b"], seeds["a"], pairs["a"])
        origins, (origin, asked) = _places(seeds["origin"], pairs["origin"])
        n, precision = len(nodes), links["category"].to_numpy().astype(np.int64)
        tiers = np.unique(precision)
        rank = np.empty(n, np.int64)
        rank[pc.sort_indices(nodes).to_numpy()] = np.arange(n)
        into = np.lexsort((rank[src], dst))
        before, cost, at = src[into], np.searchsorted(tiers, precision[into]), np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=n))])
        graphs = [_Graph(src[precision <= t], dst[precision <= t], n) for t in tiers] or [_Graph(src, dst, n)]
        few = max(1, min(64 * WORDS, GATHERED // max(1, len(src)) * 64, 2 * GATHERED // (n * len(graphs))))
        far = np.iinfo(np.int32).max
        for k in range(0, len(origins), few):
            own, mine = (origin >= k) & (origin < k + few), (asked >= k) & (asked < k + few)
            if not own.any() or not mine.any():
                continue
            words = -(-few // 64)
            dist = np.full((len(graphs), n, few), far, np.int32)
            for d, graph in zip(dist, graphs, strict=True):
                for step, to, bits, _ in graph.levels(start[own], origin[own] - k, words, None, np.zeros((n, words), np.uint64)):
                    for row, place in _pairs(bits):
                        d[to[row], place] = step

            def label(node, place, length, dist=dist):
                """The place of the worst precision by which a node is first reached in just so many steps, -1 at the origin, ``far`` if it is not."""
                worst = np.full(len(node), far, np.int64)
                for t in reversed(range(len(dist))):
                    worst = np.where(dist[t][node, place] <= length, np.where(dist[t][node, place] == length, t, far), worst)
                return np.where((worst < far) & (length == 0), -1, worst)

            ends, place = target[mine], asked[mine] - k
            best = dist[:, ends, place] < far
            met = best.any(axis=0)
            ends, place, first = ends[met], place[met], best.argmax(axis=0)[met]
            length = dist[first, ends, place].astype(np.int64)
            rows = max(1, CELLS // (int(length.max(initial=0)) + 1))
            for j in range(0, len(ends), rows):
                e, p, size = ends[j : j + rows], place[j : j + rows], length[j : j + rows]
                worst = np.where(size == 0, -1, first[j : j + rows])
                path = self._walked(e, p, size, worst.copy(), label, before, cost, at)
                offsets = np.concatenate([[0], np.cumsum(size + 1)])
                flat = path[np.repeat(np.arange(len(e)), size + 1), np.repeat(offsets[1:] - 1, size + 1) - np.arange(offsets[-1])]
                value = np.where(worst < 0, -1, tiers[np.maximum(worst, 0)] if len(tiers) else -1)
                columns = {
                    "origin": origins.take(pa.array(p + k)), "node": nodes.take(pa.array(e)), "worst": pa.array(value.astype(np.int32)), "length": pa.array(size.astype(np.int32)),
                    "path": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), nodes.take(pa.array(flat))),
                }
                yield pa.RecordBatch.from_arrays([columns[x] for x in names], names=names)

    @staticmethod
    def _walked(ends, place, length, worst, label, before, cost, at) -> np.ndarray:
        """The nodes of each path, the end first."""
        path = np.zeros((len(ends), int(length.max(initial=0)) + 1), np.int64)
        path[:, 0] = ends
        for step in range(1, path.shape[1]):
            row = np.flatnonzero(length >= step)
            node, left = path[row, step - 1], length[row] - step
            edge, end = at[node], at[node + 1]
            while len(row):
                prior = label(before[edge], place[row], left)
                hit = (prior < np.iinfo(np.int32).max) & (np.maximum(prior, cost[edge]) == worst[row])
                path[row[hit], step], worst[row[hit]] = before[edge[hit]], prior[hit]
                more = ~hit & (edge + 1 < end)
                row, edge, end, left = row[more], edge[more] + 1, end[more], left[more]
        return path


def fits(*frames: DataFrame) -> bool:
    """Whether ends and origins are values that a task can tell apart."""
    return all(isinstance(f.dataType, AtomicType) for df in frames for f in df.schema.fields if f.name in ("src", "dst", "node", "origin"))


def search(links: DataFrame, seeds: DataFrame, how: Search | Precise, stops: DataFrame | None = None, targets: DataFrame | None = None, most: int = LINKS) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """``origin``, ``node``, ``dist``, with ``parent`` or ``category`` and ``clean``; and the edges and seeds of islands of more than ``most`` edges, which are not searched, or None.

    ``links``: ``src``, ``dst`` and for ``Precise`` ``precision``, ``seeds``: ``origin``, ``node``, both written and distinct, without nulls; ``stops``, ``targets``: ``node``, ``category`` as a place in
    ``how.kinds``, or ``origin`` where they are pairs."""
    from lodestone.operators.graph import components

    cores = max(1, links.sparkSession.sparkContext.defaultParallelism)
    if isinstance(how, Precise):
        names = ["origin", "node", "worst", "length", "path"]
    else:
        names = ["origin", "node", "dist"] + ["parent"] * how.parents + ["category", "clean"] * (how.kinds is not None)
    total, rest, ends = links.count(), None, links.select("src", "dst")
    if total <= most:
        placed, asked, groups = links.withColumn("grp", F.lit(0).cast("long")), seeds.withColumn("grp", F.lit(0).cast("long")), 1
        marked = lambda rows: rows.withColumn("grp", F.lit(0).cast("long"))
    else:
        tied = written(ends.mapInArrow(_forest, ends.schema), "forest")
        roots = written(components(tied), "islands")
        asked = seeds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        asked = written(asked, "island-seeds")
        used = written(links.join(roots.withColumnRenamed("node", "src"), "src").join(asked.select("root").distinct(), "root", "left_semi"), "island-links")
        sizes = written(used.groupBy("root").agg(F.count(F.lit(1)).alias("_n")), "island-sizes")
        few = max(1, 2 * total // most)
        groups = few + sizes.filter(F.col("_n") > most // 8).count()
        # small islands share a group, others are one each
        group = F.when(F.col("_n") > most, F.lit(None)).otherwise(F.when(F.col("_n") > most // 8, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(few))))
        homes = asked.select("root").distinct()
        sizes = sizes.select("root", group.alias("grp"), (F.col("_n") > most).alias("large"))
        placed, asked = used.join(sizes, "root"), asked.join(sizes, "root", "left")
        if not sizes.filter("large").isEmpty():
            rest = (placed.filter("large").select(*links.columns), asked.filter("large").select("origin", "node"))
            placed, asked = placed.filter("NOT large"), asked.filter("large IS NULL OR NOT large")
        # a seed without edges has no island of its own
        alone = F.coalesce("grp", F.pmod(F.xxhash64("root"), F.lit(few)))
        asked = asked.withColumn("grp", alone)
        marked = lambda rows: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(homes, "root", "left_semi").join(sizes, "root", "left").filter("large IS NULL OR NOT large").withColumn("grp", alone)
    # where islands are few, each is searched by several tasks, a part of its origins each
    slices = max(1, min(64, -(-2 * cores // groups)))
    part = F.when(F.lit(slices) == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("origin"), F.lit(slices))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    node, origin = seeds.schema["node"].dataType, seeds.schema["origin"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    rows = placed.select("grp", every.alias("part"), F.lit(0).alias("kind"), F.col("src").cast(node).alias("a"), F.col("dst").cast(node).alias("b"), none(origin).alias("origin"), (F.col("precision").cast("int") if "precision" in links.columns else none("int")).alias("category"))
    rows = rows.union(asked.select("grp", part.alias("part"), F.lit(1).alias("kind"), F.col("node").alias("a"), none(node).alias("b"), "origin", none("int").alias("category")))
    for kind, marks in ((2, stops), (3, targets)):
        if marks is not None:
            m = marked(marks)
            given = lambda c, kind: (F.col(c).cast(kind) if c in m.columns else none(kind)).alias(c)  # noqa: B023, E731
            to = part if "origin" in m.columns else every
            rows = rows.union(m.select("grp", to.alias("part"), F.lit(kind).alias("kind"), F.col("node").cast(node).alias("a"), none(node).alias("b"), given("origin", origin), given("category", "int")))
    kinds = {"origin": origin.simpleString(), "node": node.simpleString(), "dist": "int", "parent": node.simpleString(), "category": "string", "clean": "boolean", "worst": "int", "length": "int", "path": f"array<{node.simpleString()}>"}
    dealt = rows.repartition(min(2000, groups * slices), "grp", "part")
    return dealt.groupBy("grp", "part").applyInArrow(how.answer(names), ", ".join(f"{x} {kinds[x]}" for x in names)), rest
