"""Benchmark decontamination: suffix arrays of the corpus, in which every suffix of every benchmark item is searched.

The documents are cut into shards of whole texts.  A shard's suffix array orders the places of its words by the words that follow: ranks are
refined by as many words at a time as fit into 64 bits, then by as many ranks, and only places that still tie are sorted
again.  Every test suffix, an item from one of its words on, is binary-searched in every shard: the interval of places that match its first
word, within it that of the first two, and so on, until nothing matches.  The last interval that holds a place is the suffix's longest verbatim
match with its locations; the one at the depth of a window is where the window occurs.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.  A word of a document
that lies within any occurrence of a window is hit; a document with a hit is contaminated, and ``clean`` removes it.

Words are numbered by their bytes in every shard (a dictionary, no hashes), so a match is one of words.  Equal windows, of whatever items, are one search and one
set of places: a passage that a third of the items share costs what one costs, but for the list of items that a row names.

The benchmark is searched in chunks of about ``CHUNK_BYTES`` of text, one broadcast each; one chunk is one pass
over the corpus, without a shuffle.  With several, the documents are written once and a document's rows of all chunks are put together by key.

Defined results: words are runs of digits, letters a-z (A-Z are lower-cased first) and characters beyond U+007F; a null or empty text has no words, in
a document or in an item, and matches nothing; very long texts are shards of their own; matches never cross from one text into another; repeated rows of
documents are judged alike, repeated items count once by id; a null item id is listed as an empty string; an empty corpus gives an empty table and an empty
benchmark finds nothing; other columns are carried over by ``clean`` only, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import Words, words_of
from lodestone.llm.common import group_starts, slices, written

WIDTH = 10
SHARD_BYTES = 4 << 20
CHUNK_BYTES = 8 << 20
#: Occurrences looked at at once.
AT_ONCE = 1 << 18
_NO_ID = np.iinfo(np.int64).max
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``symbols`` other than 0 in the order of what follows, up to ``depth`` symbols at least; 0 ends a text.

    Places that are alike up to the end of their texts, or to ``depth``, are in any order."""
    order = np.flatnonzero(symbols)
    end = len(symbols)
    if not len(order):
        return order
    rank = np.append(symbols, 0)
    active, held = np.arange(len(order)), order
    covered, bits = 1, int(rank.max()).bit_length()
    while True:
        several = max(2, 63 // bits)
        key = rank[held].astype(np.uint64)
        for k in range(1, several):
            key = key << np.uint64(bits) | rank[np.minimum(held + k * covered, end)].astype(np.uint64)
        by = np.argsort(key)
        held, key = held[by], key[by]
        order[active] = held
        # a group's rank is the slot of its first place, so groups that are apart keep theirs
        starts = group_starts(key)
        sizes = np.diff(starts, append=len(held))
        slot = np.repeat(active[starts] + 1, sizes)
        if covered == 1:
            rank = np.zeros(end + 1, np.int64)
        rank[held] = slot
        covered *= several
        tied = np.repeat(sizes > 1, sizes)
        if covered >= depth or not tied.any():
            return order
        active, held = active[tied], held[tied]
        bits = (len(order) + 1).bit_length()


def _words(texts: list[str | None]) -> tuple[Words, pa.Array]:
    """The words of texts, and their bytes."""
    words = words_of(texts, lower=True, between=_BETWEEN)
    inside = words.data[~_BETWEEN[words.data]]
    offsets = np.append(0, np.cumsum(words.end - words.start)).astype(np.int32)
    return words, pa.Array.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])


class Shard:
    """Texts, their words and their suffix array."""

    def __init__(self, texts: list[str | None], depth: int):
        self.words, each = _words(texts)
        self.doc = self.words.doc
        numbered = each.dictionary_encode()
        self.vocabulary = numbered.dictionary
        # a 0 after the words of each text, and what a word's place is among them
        self.symbols = np.zeros(len(self.doc) + len(texts), np.int64)
        self.symbols[np.arange(len(self.doc)) + self.doc] = numbered.indices.to_numpy(zero_copy_only=False) + 1
        self.word = np.cumsum(self.symbols > 0) - 1
        self.order = suffix_array(self.symbols, depth)

    def search(self, tests: Tests) -> Found:
        """The longest match of every test suffix, and the interval of its window."""
        n, order = len(tests.start), self.order
        known = pc.fill_null(pc.index_in(tests.vocabulary, value_set=self.vocabulary), -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        wanted = known[tests.numbers]
        first = self.symbols[order]
        lo, hi = np.searchsorted(first, wanted, "left"), np.searchsorted(first, wanted, "right")
        found = Found(np.zeros(n, np.int64), *(np.zeros(n, np.int64) for _ in range(4)))
        alive, depth = np.arange(n), 0
        while True:
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
            depth += 1
            found.length[alive], found.lo[alive], found.hi[alive] = depth, lo, hi
            here = tests.window[alive] == depth
            found.window_lo[alive[here]], found.window_hi[alive[here]] = lo[here], hi[here]
            more = tests.size[alive] > depth
            alive, lo, hi = alive[more], lo[more], hi[more]
            if not len(alive):
                return found
            next_word = wanted[tests.start[alive] + depth]
            lo, hi = self._bound(lo, hi, next_word, depth), self._bound(lo, hi, next_word + 1, depth)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
        """The first place of each interval whose word at ``depth`` is not below the wanted one."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.arange(len(lo))
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.symbols[self.order[mid] + depth] < wanted[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def places(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, which interval) of all places in intervals of the suffix array, some at a time."""
        ends = np.cumsum(hi - lo)
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, AT_ONCE):
            at = np.arange(a, min(a + AT_ONCE, total))
            which = np.searchsorted(ends, at, "right")
            yield self.word[self.order[hi[which] - (ends[which] - at)]], which


@dataclass
class Found:
    """Of each test suffix: how many words match somewhere, the interval of these places, and that of its window's."""

    length: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    window_lo: np.ndarray
    window_hi: np.ndarray


class Tests:
    """A chunk of the benchmark: its distinct texts, their words (``numbers`` into ``vocabulary``), and every suffix of each.

    ``start``, ``size``: a suffix's first word and how many it has; ``window``: words of the window with which it begins, 0: none;
    ``distinct``: one suffix of each distinct window; ``items``: which items have the window of such a suffix."""

    def __init__(self, ids: list, texts: list[str | None], width: int):
        by_text: dict[str | None, set[str]] = {}
        for i, t in zip(ids, texts, strict=True):
            by_text.setdefault(t, set()).add("" if i is None else str(i))
        words, each = _words(list(by_text))
        numbered = each.dictionary_encode()
        self.vocabulary, self.numbers = numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False)
        first, text = words.first, words.doc
        self.start = np.arange(len(text))
        self.size = first[text + 1] - self.start if len(text) else self.start
        self.window = np.where(self.size >= width, width, np.where(self.start == first[text], self.size, 0)) if len(text) else self.start
        self.longest = int(self.size.max()) if len(text) else 0
        self.of_text = list(by_text.values())
        seen: dict[bytes, int] = {}
        self.texts_of: dict[int, set[int]] = {}
        for k in np.flatnonzero(self.window).tolist():
            window = self.numbers[k : k + int(self.window[k])].tobytes()
            self.texts_of.setdefault(seen.setdefault(window, k), set()).add(int(text[k]))
        self.distinct = np.array(list(self.texts_of), np.int64)
        self.text, self.first = text, first
        self.named: dict[frozenset[int], list[str]] = {}

    def items(self, suffixes: list[int]) -> list[str]:
        """The items that have one of the windows with which the suffixes begin, sorted."""
        texts = frozenset(itertools.chain.from_iterable(self.texts_of[k] for k in suffixes))
        if texts not in self.named:
            if len(self.named) >= 4096:
                self.named.clear()
            self.named[texts] = sorted(set().union(*(self.of_text[t] for t in texts)))
        return self.named[texts]


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, list[int]]:
    """``id``, ``text``, ``chunk`` of the distinct rows, written, and the chunks' numbers: dealt by hash, none beyond twice ``chunk_bytes`` and its longest text."""
    kept = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    held = written(benchmark.sparkSession, kept, "benchmark-items")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    n = max(1, math.ceil((held.agg(F.sum(size)).first()[0] or 0) / chunk_bytes))
    while True:
        dealt = held.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
        sizes = dealt.groupBy("chunk").agg(F.sum(size).alias("all"), F.max(size).alias("most")).collect()
        if all(r["all"] <= 2 * chunk_bytes + r["most"] for r in sizes):
            return dealt, sorted(r.chunk for r in sizes)
        n *= 2


class _Searched:
    """The chunks of a benchmark, one after the other, as broadcasts."""

    def __init__(self, benchmark: DataFrame, width: int, item_col: str, text_col: str, chunk_bytes: int):
        self.context, self.width = benchmark.sparkSession.sparkContext, width
        self.table, self.names = _chunks(benchmark, item_col, text_col, chunk_bytes)

    def __iter__(self):
        for name in self.names or [None]:
            rows = self.table.filter(F.col("chunk") == name).collect() if name is not None else []
            yield self.context.broadcast(Tests([r.id for r in rows], [r.text for r in rows], self.width))


def _judged(texts: list[str | None], tests: Tests) -> tuple[Shard, np.ndarray, np.ndarray]:
    """The shard, whether each word is hit, and the distinct pairs of a document and a suffix whose window it has (document << 32 | suffix)."""
    shard = Shard(texts, tests.longest)
    edge = np.zeros(len(shard.doc) + 1, np.int64)
    pairs = []
    found = shard.search(tests)
    seen = tests.distinct[found.window_lo[tests.distinct] < found.window_hi[tests.distinct]]
    for word, which in shard.places(found.window_lo[seen], found.window_hi[seen]):
        suffix = seen[which]
        edge += np.bincount(word, minlength=len(edge))
        edge -= np.bincount(word + tests.window[suffix], minlength=len(edge))
        pairs.append(np.unique(shard.doc[word] << 32 | suffix))
    return shard, np.cumsum(edge)[:-1] > 0, np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """A row per document: the id, ``n_words``, ``spans`` (runs of hit words: first word, end), ``items`` (of which windows occur; sorted as strings)."""
    searched = _Searched(benchmark, width, item_col, item_text_col, chunk_bytes)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    several = len(searched.names) > 1
    if several:
        kept = written(docs.sparkSession, kept.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "decontaminated-texts")
    fields = kept.drop("text").columns
    schema = ", ".join(f"{n} {kept.schema[n].dataType.simpleString()}" for n in fields)
    schema += ", n_words long, spans array<struct<start:long,end:long>>, items array<string>"

    def of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                texts = batch.column(len(fields))
                for at, rows in slices(texts, SHARD_BYTES, 1 << 16):
                    shard, hit, pairs = _judged(texts.slice(at, rows).to_pylist(), tests)
                    yield _named(batch.slice(at, rows), fields, shard, hit, pairs, tests)

        return run

    found = [kept.select(*fields, "text").mapInArrow(of(shared), schema) for shared in searched]
    if several:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        put = every.groupBy("row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        return put.select(F.col("id").alias(id_col), "n_words", _joined("spans").alias("spans"), "items")
    return found[0].withColumnRenamed("id", id_col)


def _named(batch: pa.RecordBatch, fields: list[str], shard: Shard, hit: np.ndarray, pairs: np.ndarray, tests: Tests) -> pa.RecordBatch:
    first = shard.words.first
    n = batch.num_rows
    spans: list[list[dict]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    if len(pairs):
        doc = pairs >> 32
        # runs of hit words, cut where a text ends
        begins = hit & ~np.append(False, hit[:-1] & (shard.doc[1:] == shard.doc[:-1]))
        ends = hit & ~np.append(hit[1:] & (shard.doc[1:] == shard.doc[:-1]), False)
        for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist(), strict=True):
            d = int(shard.doc[a])
            spans[d].append({"start": a - int(first[d]), "end": b + 1 - int(first[d])})
        cuts = group_starts(doc).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
            items[int(doc[a])] = tests.items((pairs[a:b] & 0xFFFFFFFF).tolist())
    columns = [batch.column(k) for k in range(len(fields))]
    columns += [pa.array(np.diff(first)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[*fields, "n_words", "spans", "items"])


def _joined(spans: str) -> Column:
    """Sorted spans, those that touch or overlap put together."""
    last = lambda a: F.element_at(a, -1)
    both = lambda a, s: F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))
    return F.aggregate(
        spans,
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.try_element_at(a, F.lit(-1))["end"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(both(F.when(F.size(a) > 0, a), s)))).otherwise(F.concat(a, F.array(s))),
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs; with several chunks each is searched in what the last one left."""
    searched = _Searched(benchmark, width, item_col, item_text_col, chunk_bytes)
    place = docs.columns.index(text_col)

    def of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, rows in slices(batch.column(place), SHARD_BYTES, 1 << 16):
                    part = batch.slice(at, rows)
                    hit = np.zeros(rows, bool)
                    hit[_judged(part.column(place).to_pylist(), shared.value)[2] >> 32] = True
                    yield part.filter(pa.array(~hit))

        return run

    left = docs
    for k, shared in enumerate(searched):
        left = left.mapInArrow(of(shared), docs.schema)
        if k + 1 < len(searched.names):
            left = written(docs.sparkSession, left, "decontaminated")
    return left


def longest(
    docs: DataFrame, benchmark: DataFrame, least: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The longest verbatim match of every test suffix that has one of ``least`` words or more: ``item_id`` (as a string), ``start`` (word of the item),
    ``length``, ``n`` (places in the corpus that match so far), and the first of them: ``doc_id`` and ``place`` (word of the document)."""
    searched = _Searched(benchmark, least, item_col, item_text_col, chunk_bytes)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                for at, rows in slices(batch.column(1), SHARD_BYTES, 1 << 16):
                    shard = Shard(batch.column(1).slice(at, rows).to_pylist(), tests.longest)
                    found = shard.search(tests)
                    ids = pc.fill_null(batch.column(0).slice(at, rows), _NO_ID).to_numpy(zero_copy_only=False)
                    yield _located(shard, tests, found, ids, least)

        return run

    rows = None
    for shared in searched:
        more = kept.mapInArrow(of(shared), "item_id string, start long, length long, n long, doc_id long, place long")
        rows = more if rows is None else rows.union(more)
    best = rows.groupBy("item_id", "start").agg(F.max("length").alias("length"))
    at = rows.join(best, ["item_id", "start", "length"]).groupBy("item_id", "start", "length")
    put = at.agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    return put.select("item_id", "start", "length", "n", F.nullif(F.col("first.doc_id"), F.lit(_NO_ID)).alias("doc_id"), F.col("first.place").alias("place"))


def _located(shard: Shard, tests: Tests, found: Found, ids: np.ndarray, least: int) -> pa.RecordBatch:
    """A row per item and suffix with a match: its length, how many places have it, and the first of these."""
    chosen = np.flatnonzero(found.length >= least)
    interval, which = np.unique(found.lo[chosen] << 32 | found.hi[chosen], return_inverse=True)
    doc, place = np.full(len(interval), _NO_ID), np.zeros(len(interval), np.int64)
    for word, k in shard.places(interval >> 32, interval & 0xFFFFFFFF):
        # of each interval the least id, then the least place; the intervals come one after the other
        own, at = ids[shard.doc[word]], word - shard.words.first[shard.doc[word]]
        by = np.lexsort((at, own, k))
        starts = by[group_starts(k[by])]
        better = (own[starts] < doc[k[starts]]) | (own[starts] == doc[k[starts]]) & (at[starts] < place[k[starts]]) | (doc[k[starts]] == _NO_ID) & (place[k[starts]] == 0)
        doc[k[starts][better]], place[k[starts][better]] = own[starts][better], at[starts][better]
    rows = []
    for suffix, k in zip(chosen.tolist(), which.tolist(), strict=True):
        lo, hi, text = int(found.lo[suffix]), int(found.hi[suffix]), int(tests.text[suffix])
        for item in tests.of_text[text]:
            rows.append((item, suffix - int(tests.first[text]), int(found.length[suffix]), hi - lo, int(doc[k]), int(place[k])))
    names = ["item_id", "start", "length", "n", "doc_id", "place"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if n == "item_id" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)
