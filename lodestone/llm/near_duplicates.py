"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct ``width``-word shingles (A-Z lower-cased; a text of fewer words is one shingle).  Documents with
one set are one node.  A node's signature is ``SYMBOLS`` minhash values of 16 bits.  Two sets of similarity 0.8
differ in 12.8 of 64 values on average, with a standard deviation of 3.2; the join returns every pair that differs in
``DISTANCE`` = 27 at most, which misses a pair of similarity exactly 0.8 once in 60,000, and one of 0.85
practically never.  That share is the method's: there is no other path beside the join.

The join is exact for that distance: with ``CHUNKS`` = 14 chunks a pair within 27 has a chunk with one error at most, as
14 chunks of two errors or more make 28.  Hence for each chunk and each place of an error the other values of the
chunk form a key, and such a pair shares a key.  Keys of several nodes get their signatures; within a key the nodes are
linked by a spanning forest of the distances, never by all pairs.

The linked nodes form coarse classes.  Within a class the whole sets are compared, again as a spanning forest: nodes are taken
one after the other, each is compared with those that nothing has reached yet, and what it reaches is
linked to it.  Each pair that could join two parts is compared, hence the components are those of all links.

Keys or classes of any size are handled in cells of bounded size: the nodes are dealt into groups, and every pair of
groups is a cell of its own, so the cells together see every pair.  Only distinct sets count; copies are one node however
many there are.

Defined results: a document without words, or with a null text, has an empty set (``n_shingles`` 0), is linked with
nothing and is its own component; a null id has component null unless its component holds an id; ``kept`` is whether the
id is the component's least (null ids: false); rows that share an id are separate documents of one id, so of a component's several rows
with its least id all are ``kept`` by ``classes``, and ``one_of_each`` keeps the one whose text has the least digest; repeated
rows get equal results; very long texts count whole; an empty table gives an empty table; columns other than the id and the text
are carried by ``one_of_each`` only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.arrays import mixed, random_u64, windows, words_of
from lodestone.llm.common import group_starts, slices, whole_groups, written
from lodestone.llm.graph import components

WIDTH = 5
#: Similarity as a percentage.
SIMILAR = 80
SYMBOLS, CHUNKS, DISTANCE = 64, 14, 27
#: Nodes of a key, and shingles of a class, that a group of a cell holds, about.
GROUP_NODES = 4096
GROUP_SHINGLES = 2_000_000
#: Rows of keys up to which they are broadcast, some 20 MB as hashes and 60 MB as strings; beyond it the same join shuffles the texts.
MOST_HASHES, MOST_KEYS = 1_000_000, 500_000

_FLIPS, _FACTORS = random_u64(SYMBOLS, 21), random_u64(SYMBOLS, 22)
_KEY_FACTORS = random_u64(SYMBOLS * SYMBOLS, 23).reshape(SYMBOLS, SYMBOLS)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within a text; where each text's begin, and the end."""
    words = words_of(texts, lower=True)
    hashes = words.hashes()
    found, at = windows(hashes, words.first, width, 3)
    doc = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        weights = random_u64(width, 4)
        whole = np.array([(hashes[words.first[k] : words.first[k + 1]] * weights[: counts[k]]).sum() + np.uint64(counts[k]) for k in short], np.uint64)
        found, doc = np.concatenate((found, mixed(whole))), np.concatenate((doc, short))
    every = np.lexsort((found, doc))
    found, doc = found[every], doc[every]
    if len(found):
        first = group_starts(doc, found)
        found, doc = found[first], doc[first]
    return found, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sets x ``SYMBOLS``; no set is empty."""
    out = np.empty((len(first) - 1, SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((found ^ _FLIPS[k]) * _FACTORS[k], first[:-1])
        out[:, k] = (least >> np.uint64(16)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Sets x keys: for each chunk and each place of its error, a hash of the chunk's other values."""
    wide = signature.astype(np.uint64) + np.uint64(1)
    out = []
    for chunk in np.array_split(np.arange(SYMBOLS), CHUNKS):
        for error in chunk:
            rest = [k for k in chunk if k != error]
            out.append(mixed((wide[:, rest] * _KEY_FACTORS[error, rest]).sum(axis=1, dtype=np.uint64) + np.uint64(error)))
    return np.stack(out, axis=1)


def spanning(group: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group: two arrays of rows.

    ``group`` is sorted.  In every round each unfinished group takes a row, one already reached if there is one, and
    ``near(taken, others)`` says which of the rows not reached yet are linked to it."""
    state = np.zeros(len(group), np.int8)  # 0: not reached, 1: reached, 2: taken
    active, a, b = np.arange(len(group)), [], []
    while len(active):
        starts = group_starts(group[active])
        sizes = np.diff(np.append(starts, len(active)))
        s = state[active]
        n = len(active)
        taken = np.minimum.reduceat(np.where(s == 1, 0, n) + np.arange(n), starts) % n
        s[taken] = 2
        open_ = np.flatnonzero(s == 0)
        own = np.repeat(taken, sizes)[open_]
        hit = near(active[own], active[open_])
        s[open_[hit]] = 1
        a.append(active[own[hit]])
        b.append(active[open_[hit]])
        state[active] = s
        left = np.add.reduceat(s == 0, starts) > 0
        active = active[np.repeat(left, sizes) & (s != 2)]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _by_signature(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    return spanning(_groups(table, "key", "cell"), lambda p, r: (signature[p] != signature[r]).sum(axis=1) <= DISTANCE)


def _groups(table: pa.Table, *names: str) -> np.ndarray:
    """Numbers, ascending, of the runs of equal keys."""
    starts = group_starts(*(table[n].to_numpy() for n in names))
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))


def _by_sets(table: pa.Table, width: int, similar: int) -> tuple[np.ndarray, np.ndarray]:
    found, first = shingle_sets(table["text"].to_pylist(), width)
    size, group = np.diff(first), _groups(table, "class", "cell")
    # a number for each shingle of a group
    names, number = np.unique(found ^ mixed(np.repeat(group, size).astype(np.uint64)), return_inverse=True)
    marked = np.zeros(len(names), bool)

    def members(rows: np.ndarray) -> np.ndarray:
        n = size[rows]
        return number[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def near(taken: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        fits = np.flatnonzero(100 * np.minimum(size[taken], size[rows]) >= similar * np.maximum(size[taken], size[rows]))
        if not len(fits):
            return out
        t, r = taken[fits], rows[fits]
        own = members(np.unique(t))
        marked[own] = True
        common = np.add.reduceat(marked[members(r)].astype(np.int64), np.cumsum(size[r]) - size[r])
        marked[own] = False
        out[fits] = 100 * common >= similar * (size[t] + size[r] - common)
        return out

    return spanning(group, near)


def _forest(rows: DataFrame, keys: list[str], linked: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], least_rows: int) -> DataFrame:
    """Edges ``a``, ``b`` between the ``num`` of rows with equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, least_rows):
            num = table["num"].to_numpy()
            a, b = linked(table)
            yield pa.RecordBatch.from_arrays([pa.array(num[a]), pa.array(num[b])], names=["a", "b"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "num")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _cells(groups: Column) -> tuple[Column, Column]:
    """The cells of a row, and what explodes them: a group's number is a hash of ``num``."""
    own = F.pmod(F.xxhash64("num"), groups)
    others = F.filter(F.sequence(F.lit(0).cast("long"), groups - 1), lambda j: (groups == 1) | (j != own))
    return F.explode(others).alias("other"), F.least(own, F.col("other")) * groups + F.greatest(own, F.col("other"))


def _row_key(id_col: str, text_col: str) -> Column:
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), F.md5(F.col(text_col)))


def _measured(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key`` (of the row's id and text), ``n_shingles``, ``node`` (a digest of the set; null: no set), ``signature``."""
    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(2), 1 << 19):
                part = batch.slice(at, n)
                found, first = shingle_sets(part.column(2).to_pylist(), width)
                size = np.diff(first)
                some = np.flatnonzero(size)
                node, signature = [None] * n, [None] * n
                if len(some):
                    for k, s in zip(some.tolist(), signatures(found, np.append(first[some], len(found))), strict=True):
                        node[k] = hashlib.blake2b(found[first[k] : first[k + 1]], digest_size=16).digest()
                        signature[k] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(signature, pa.binary())],
                    names=["id", "key", "n_shingles", "node", "signature"],
                )
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"id {kind}, key string, n_shingles long, node binary, signature binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), *batch.columns], names=["num", *batch.schema.names])
        at += batch.num_rows


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(signature)
            num = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(num)], names=["key", "num"])


def classes(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the id, ``n_shingles``, ``component_id``, ``kept``; and ``node``, ``row_key`` for joins.

    ``similar``: the least similarity, as a percentage; the signatures are laid out for 80 or more."""
    if similar < SIMILAR:
        raise ValueError(f"the signature distance is laid out for similarities of {SIMILAR} % or more")
    spark = docs.sparkSession
    measured = written(spark, _measured(docs, width, id_col, text_col), "near-measured")
    kind = measured.schema["id"].dataType.simpleString()
    distinct = (
        measured.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    )
    nodes = written(
        spark,
        distinct.mapInArrow(_numbered, f"num long, node binary, least {kind}, key string, n long, signature binary"),
        "near-nodes",
    )

    # candidates: nodes that share a chunk with one error at most
    keyed = nodes.select("num", "signature").mapInArrow(_keys, "key long, num long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    explode, cell = _cells(F.col("groups"))
    dealt = (
        keyed.join(shared, "key")
        .select("key", "num", F.ceil(F.col("n") / GROUP_NODES).alias("groups"))
        .select("key", "num", "groups", explode)
        .select("key", "num", cell.alias("cell"))
    )
    coarse = _forest(dealt.join(nodes.select("num", "signature"), "num"), ["key", "cell"], _by_signature, 8192)
    near = written(spark, components(spark, coarse), "near-classes")

    # the links among them, on whole sets
    member = near.join(nodes.select("num", "n", "key"), "num").select("num", F.col("root").alias("class"), "n", "key")
    weight = member.groupBy("class").agg(F.sum("n").alias("total"))
    placed = (
        member.join(weight, "class")
        .select("class", "num", "key", F.ceil(F.col("total") / GROUP_SHINGLES).alias("groups"))
        .select("class", "num", "key", "groups", explode)
        .select("class", "num", F.col("key").alias("row_key"), cell.alias("cell"))
    )
    texts = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    # most documents are in no class; where the keys of the others are few, the rest never leaves the scan
    wanted = member.select(F.xxhash64("key").alias("hash")).distinct()
    if wanted.count() <= MOST_HASHES:
        texts = texts.join(F.broadcast(wanted), F.xxhash64("row_key") == F.col("hash"), "left_semi")
    texts = texts.dropDuplicates(["row_key"])
    links = _forest(texts.join(placed, "row_key"), ["class", "cell"], lambda t: _by_sets(t, width, similar), 64)
    linked = written(spark, components(spark, links), "near-components")

    rooted = nodes.join(linked, "num", "left").select("node", "least", F.coalesce("root", "num").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(component, "root").select("node", "component_id")
    return measured.join(named, "node", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("node").isNull(), F.col("id").isNotNull()).otherwise(F.col("id") == F.col("component_id")), F.lit(False)).alias("kept"),
        "node",
        F.col("key").alias("row_key"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, without near-duplicates: of each component one row with its least id stays.

    Rows without words have no duplicates and stay; a component of null ids only keeps one row."""
    spark = docs.sparkSession
    found = classes(docs, width, similar, id_col, text_col)
    some = found.filter("node IS NOT NULL")
    chosen = (
        some.filter("kept OR component_id IS NULL")
        .groupBy(F.coalesce(F.col("component_id").cast("string"), F.hex("node")).alias("component"))
        .agg(F.min("row_key").alias("row_key"))
        .select("row_key", F.lit(True).alias("chosen"))
    )
    # what becomes of a key's rows, where they are not one row that stays
    fate = some.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).join(chosen, "row_key", "left")
    fate = written(spark, fate.filter("chosen IS NULL OR n > 1").select(F.col("row_key").alias("_key"), F.col("chosen").isNotNull().alias("_again")), "near-fates")
    names = [F.col(f"`{n}`") for n in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), F.coalesce(_row_key(id_col, text_col), F.lit("")).alias("_key"))
    first = Window.partitionBy("_key").orderBy(F.xxhash64("_row"))
    once = lambda r: r.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("_row.*")
    if fate.count() <= MOST_KEYS:
        # only rows that are repeated are shuffled
        decided = rows.join(F.broadcast(fate), "_key", "left")
        return decided.filter("_again IS NULL").select("_row.*").union(once(decided.filter("_again")))
    # rows without words are many under one key; they stay where they are
    bare = ~F.coalesce(F.col("_row")[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return rows.filter(bare).select("_row.*").union(once(rows.filter(~bare).join(fate, "_key", "left").filter("_again IS NULL OR _again")))
