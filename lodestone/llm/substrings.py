"""Substring dedup: relative Lempel-Ziv parsing against the blocks of the corpus.

The corpus is cut into reference blocks of whole documents, written once.  Every block is indexed by the places of its phrases, runs
of ``width`` words, and every document is factored greedily against all indexed blocks: the factor that begins at a
word is the longest one that a phrase which covers the word gives, and a word that no phrase covers is
a literal.  A factor is (first word, length, block, place): its words are those of the block from that place on, so a document can be
read back from its factors and literals (``decoded``).  The source of a phrase is its first place in the document with the least id, and
a factor runs on as long as the next phrase lies at the next place of the same source.

Factors are checked at their boundaries: where one ends, the phrases across the boundary, which begin in it and reach beyond it, are looked
at as well, and the one that reaches farthest begins the next factor.  So no repeated run of ``width`` words is lost between two factors, and the
factors together are the duplicate spans.

The index is spread over the cluster in two rounds, so that no task sees more than a bucket of it:

1. The anchor of a phrase is the least hash of its runs of ``ANCHOR`` words; equal phrases have equal anchors.  Each block
   sends the distinct anchors of its phrases, 4 bytes each, to buckets by hash; a bucket answers, a bit each, which
   occur in several documents.  Only phrases with such an anchor go on.  A false alarm costs a row in round 2.
2. Each block sends those phrases, each as a name and a proof (two hashes of 64 bits with weights of their own), with the least id it has in the block and its first place there; a
   bucket answers which have a smaller id in another block, and names the block and the place.  Blocks know the rest themselves.

Phrases are equal if names and proofs are, 128 bits together: among 10^13 unlike phrases two are taken for one with a probability of 10^-13.  Names alone are never trusted (``name_bits`` shortens
them, so that tests can force collisions).  A phrase, however frequent, is one entry for each block.  Buckets number in proportion
to the corpus, so a bucket's size is steady; the entries of messages and answers are linear in the text, and a message holds one
entry at least, so the messages are, too.

Defined results: a null or an empty text has no words, no spans and an empty kept text; texts of fewer than ``width`` words
stay whole; very long texts are parsed whole (a block of their own); a null id counts as larger than every other,
so such a row loses what occurs under any id; rows that share an id never count as each other's source, so
repeated rows get equal results but for the factors' sources; of equal ids the source is in the least block; an empty table gives
an empty table; columns other than the id and the text are not carried over.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import Words, mixed, windows, words_of
from lodestone.llm.common import group_starts, slices, whole_groups, written

WIDTH = 13
ANCHOR = 5
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096
#: Words of the corpus for each bucket, about.
BUCKET_WORDS = 2_000_000
LEAST_BUCKETS = 64
FACTOR = ["start", "length", "block", "place"]
_NO_ID = np.iinfo(np.int64).max


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reference blocks: ``block``, ``n_words``, ``payload`` (an Arrow stream of ids and texts, compressed)."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        n = 0
        for batch in batches:
            for at, rows in slices(batch.column(1), BLOCK_BYTES, BLOCK_ROWS):
                part = pa.RecordBatch.from_arrays([c.slice(at, rows) for c in batch.columns], names=["id", "text"])
                words = sum(len(t.encode().split()) for t in part.column(1).to_pylist() if t)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                block = TaskContext.get().partitionId() << 32 | n
                n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([words], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["block", "n_words", "payload"],
                )
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, "block long, n_words long, payload binary")


class Block:
    """A block's documents in the order of their ids, their words and phrases."""

    def __init__(self, payload: bytes, width: int, name_bits: int = 64):
        table = pa.ipc.open_stream(payload).read_all()
        ids = table["id"].to_pylist()
        self.order = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        self.ids, self.texts, self.width = ids, table["text"].to_pylist(), width
        self.words: Words = words_of(self.texts)
        hashes = self.words.hashes()
        self.phrases, self.start = windows(hashes, self.words.first, width, 1)
        self.phrases &= np.uint64((1 << name_bits) - 1 << 64 - name_bits)
        self.proofs = windows(hashes, self.words.first, width, 5)[0]
        self.doc = self.words.doc[self.start]
        short = min(ANCHOR, width)
        small, at = windows(hashes, self.words.first, short, 2)
        least = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
        least[at] = small
        # the least of each run of width - short + 1, by doubling
        run, reach = width - short + 1, 1
        while reach < run:
            step = min(reach, run - reach)
            least = np.append(np.minimum(least[:-step], least[step:]), least[len(least) - step :]) if len(least) > step else least
            reach += step
        self.anchors = mixed(least[self.start])

    def anchor_messages(self, n_buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, sorted anchors of 32 bits, which of them several documents of the block have)."""
        first = group_starts(self.anchors, self.doc) if len(self.doc) else np.empty(0, np.int64)
        anchors, doc = self.anchors[first], self.doc[first]
        bucket, short = _places(anchors, n_buckets)
        every = np.lexsort((doc, short, bucket))
        bucket, short, doc = bucket[every], short[every], doc[every]
        starts = group_starts(bucket, short) if len(bucket) else np.empty(0, np.int64)
        several = np.maximum.reduceat(doc, starts) != doc[starts] if len(starts) else np.empty(0, bool)
        bucket, short = bucket[starts], short[starts]
        cuts = group_starts(bucket).tolist() if len(bucket) else []
        return [
            (int(bucket[a]), short[a:b], several[a:b]) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)
        ]

    def candidates(self, n_buckets: int, answers: dict[int, Answer]) -> np.ndarray:
        """Which phrases have an anchor that occurs in several documents."""
        marked = []
        for bucket, short, _ in self.anchor_messages(n_buckets):
            if bucket in answers:
                hit = np.unpackbits(np.frombuffer(answers[bucket].bits, np.uint8), count=len(short)).astype(bool)
                marked.append(np.uint64(bucket) << np.uint64(32) | short[hit].astype(np.uint64))
        if not marked or not len(self.start):
            return np.empty(0, np.int64)
        bucket, short = _places(self.anchors, n_buckets)
        return np.flatnonzero(np.isin(bucket.astype(np.uint64) << np.uint64(32) | short, np.concatenate(marked)))

    def _distinct(self, n_buckets: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen phrases' first rows, one for each distinct phrase in the order of messages, and the distinct phrase of each chosen one."""
        hashes, proofs = self.phrases[chosen], self.proofs[chosen]
        every = np.lexsort((self.start[chosen], self.order[self.doc[chosen]], proofs, hashes, _places(hashes, n_buckets)[0]))
        starts = group_starts(hashes[every], proofs[every])
        entry = np.empty(len(chosen), np.int64)
        entry[every] = np.repeat(np.arange(len(starts)), np.diff([*starts, len(every)]))
        return chosen[every[starts]], entry

    def phrase_messages(self, n_buckets: int, chosen: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, sorted names, their proofs, the least id of each phrase, its first place under that id)."""
        if not len(chosen):
            return []
        own, _ = self._distinct(n_buckets, chosen)
        hashes, proofs, ids, at = self.phrases[own], self.proofs[own], self.order[self.doc[own]], self.start[own]
        bucket = _places(hashes, n_buckets)[0]
        cuts = group_starts(bucket).tolist()
        return [(int(bucket[a]), hashes[a:b], proofs[a:b], ids[a:b], at[a:b]) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]

    def sources(self, name: int, n_buckets: int, chosen: np.ndarray, answers: dict[int, Answer]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the block and the place of the source of the phrase that starts there; -1: there is none under a smaller id."""
        blocks, places = np.full(len(self.words.start), -1, np.int64), np.full(len(self.words.start), -1, np.int64)
        messages = self.phrase_messages(n_buckets, chosen)
        if not messages:
            return blocks, places
        least, at = (np.concatenate([m[k] for m in messages]) for k in (3, 4))
        block, place = np.full(len(least), -1, np.int64), at.copy()
        first = 0
        for bucket, own, *_ in messages:
            if bucket in answers:
                hit, known, found = answers[bucket].read(len(own))
                block[first + hit], place[first + hit] = known, found
            first += len(own)
        entry = self._distinct(n_buckets, chosen)[1]
        here = (block[entry] < 0) & (least[entry] < self.order[self.doc[chosen]])
        earlier = here | (block[entry] >= 0)
        words = self.start[chosen][earlier]
        blocks[words] = np.where(here, name, block[entry])[earlier]
        places[words] = place[entry][earlier]
        return blocks, places


@dataclass
class Answer:
    """Which hashes of a message have a source elsewhere, and where: ``bits``, the blocks' names, which of them each has, its place."""

    bits: bytes
    blocks: bytes
    which: bytes
    places: bytes

    def read(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hit = np.flatnonzero(np.unpackbits(np.frombuffer(self.bits, np.uint8), count=n))
        return hit, np.frombuffer(self.blocks, np.int64)[np.frombuffer(self.which, np.uint32)], np.frombuffer(self.places, np.uint32).astype(np.int64)


def factors(blocks: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document: (first word, length, block, place) of its factors, in order; the words between are literals.

    ``blocks``, ``places``: for each word the source of the phrase that starts there (block -1: none)."""
    at = np.flatnonzero(blocks >= 0)
    if not len(at):
        return []
    # runs of phrases that follow each other in one source
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(blocks[at]) != 0) | (np.diff(places[at]) != 1)
    first = at[new]
    runs = list(zip(first.tolist(), at[np.append(new[1:], True)].tolist(), blocks[first].tolist(), places[first].tolist(), strict=True))
    out: list[tuple[int, int, int, int]] = []
    end = k = 0
    while k < len(runs):
        # of the runs that begin no later than the next factor, the last one reaches farthest
        while k + 1 < len(runs) and runs[k + 1][0] <= end:
            k += 1
        start, last, block, place = runs[k]
        begin, stop = max(start, end), last + width
        if stop > begin:
            out.append((begin, stop - begin, block, place + begin - start))
            end = stop
        k += 1
    return out


def spans(parsed: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The runs of words that factors cover: (first word, end)."""
    out: list[tuple[int, int]] = []
    for start, length, _, _ in parsed:
        if out and start == out[-1][1]:
            out[-1] = (out[-1][0], start + length)
        else:
            out.append((start, start + length))
    return out


def _places(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), hashes & np.uint64(0xFFFFFFFF)


def _rows(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_MESSAGE_NAMES = ["bucket", "block", "hashes", "proofs", "more", "places"]
_MESSAGE_SCHEMA = "bucket long, block long, hashes binary, proofs binary, more binary, places binary"
_MESSAGE = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_ANSWER_NAMES = ["block", "bucket", "bits", "blocks", "which", "places"]
_ANSWER_SCHEMA = "block long, bucket long, bits binary, blocks binary, which binary, places binary"
_ANSWER = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
Judged = tuple[np.ndarray, np.ndarray | None, np.ndarray | None]


def _answered(messages: DataFrame, judge: Callable[[pa.Table], list[Judged]]) -> DataFrame:
    """``judge`` gives for each message of a bucket a bit for each hash, and where a set one has its source; an answer for each message with a bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            names = table["bucket"].to_numpy()
            cuts = group_starts(names).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                part = table.slice(a, b - a)
                out = []
                for block, (bits, sources, places) in zip(part["block"].to_pylist(), judge(part), strict=True):
                    if bits.any():
                        named, which = np.unique(sources, return_inverse=True) if sources is not None else (np.empty(0, np.int64),) * 2
                        packed = np.packbits(bits).tobytes(), named.tobytes(), which.astype(np.uint32).tobytes()
                        out.append([block, int(names[a]), *packed, b"" if places is None else places.astype(np.uint32).tobytes()])
                yield _rows([list(c) for c in zip(*out, strict=True)] or [[]] * len(_ANSWER), _ANSWER, _ANSWER_NAMES)

    return messages.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ANSWER_SCHEMA)


def _split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _in_several(messages: pa.Table) -> list[Judged]:
    each = [np.frombuffer(h, np.uint32) for h in messages["hashes"].to_pylist()]
    sizes = [len(x) for x in each]
    more = messages["more"].to_pylist()
    several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(more, sizes, strict=True)])
    _, which, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    flagged = np.bincount(which, weights=several, minlength=len(count)) > 0
    return [(bits, None, None) for bits in _split(((count > 1) | flagged)[which], sizes)]


def _first_sources(messages: pa.Table) -> list[Judged]:
    each = [np.frombuffer(h, np.uint64) for h in messages["hashes"].to_pylist()]
    sizes = [len(x) for x in each]
    ids = np.concatenate([_unpacked(m, n) for m, n in zip(messages["more"].to_pylist(), sizes, strict=True)])
    places = np.concatenate([np.frombuffer(p, np.uint32) for p in messages["places"].to_pylist()])
    blocks = np.repeat(messages["block"].to_numpy(), sizes)
    every = np.concatenate(each)
    proofs = np.concatenate([np.frombuffer(p, np.uint64) for p in messages["proofs"].to_pylist()])
    order = np.lexsort((blocks, ids, proofs, every))
    starts = group_starts(every[order], proofs[order])
    first = np.empty(len(order), np.int64)  # of each entry, that of its hash's source
    first[order] = np.repeat(order[starts], np.diff([*starts, len(order)]))
    out = []
    for bits, source in zip(_split(ids[first] < ids, sizes), _split(first, sizes), strict=True):
        out.append((bits, blocks[source[bits]], places[source[bits]]))
    return out


def _packed(ids: np.ndarray) -> bytes:
    """Ids as offsets of 2, 4 or 8 bytes from the least one."""
    base, top = int(ids.min()), int(ids.max())
    width = next(w for w in (2, 4, 8) if top - base < 1 << 8 * w)
    return base.to_bytes(8, "little", signed=True) + (ids.view(np.uint64) - np.uint64(base % (1 << 64))).astype(f"<u{width}").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    offsets = np.frombuffer(data, f"<u{(len(data) - 8) // n}", offset=8).astype(np.uint64)
    return (offsets + np.uint64(int.from_bytes(data[:8], "little", signed=True) % (1 << 64))).view(np.int64)


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    """One row a block; its size is bounded by the distinct phrases of the block."""
    return answers.groupBy("block").agg(F.collect_list(F.struct(*_ANSWER_NAMES[1:])).alias(name))


def _as_dict(answers: list[dict] | None) -> dict[int, Answer]:
    return {x["bucket"]: Answer(x["bits"], x["blocks"], x["which"], x["places"]) for x in answers or []}


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, reference: DataFrame | None = None, name_bits: int = 64) -> DataFrame:
    """A row per document: the id, ``n_words``, ``n_removed``, ``kept_sha256``, ``spans``, ``factors`` and ``kept`` (with ``keep_text``).

    ``factors``: (first word, length, block, place in the block's words); ``spans``: the words they cover, (first word, end); ``kept``: the
    other words, joined by one space.  ``reference``: what ``blocks`` gives for ``docs``, where a user has written it; a word's place in a
    block counts the words of all its texts, in their order."""
    spark = docs.sparkSession
    reference = written(spark, blocks(docs, id_col, text_col), "reference-blocks") if reference is None else reference
    total = reference.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET_WORDS))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Block(payload.as_py(), width).anchor_messages(n_buckets)
                yield _rows(
                    [[b for b, _, _ in found], [block] * len(found), [s.astype(np.uint32).tobytes() for _, s, _ in found], [b""] * len(found), [np.packbits(m).tobytes() for _, _, m in found], [b""] * len(found)],
                    _MESSAGE,
                    _MESSAGE_NAMES,
                )

    anchors = reference.select("block", "payload").mapInArrow(send_anchors, _MESSAGE_SCHEMA)
    first = written(spark, _answered(anchors, _in_several), "reference-anchors")

    def send_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.column(0).to_pylist()):
                own = Block(batch.column(1)[k].as_py(), width, name_bits)
                found = own.phrase_messages(n_buckets, own.candidates(n_buckets, _as_dict(batch.column(2)[k].as_py())))
                yield _rows(
                    [[m[0] for m in found], [block] * len(found), [m[1].tobytes() for m in found], [m[2].tobytes() for m in found], [_packed(m[3]) for m in found], [m[4].astype(np.uint32).tobytes() for m in found]],
                    _MESSAGE,
                    _MESSAGE_NAMES,
                )

    # a block that got no answer has no phrase to send
    asked = reference.select("block", "payload").join(_by_block(first, "anchors"), "block")
    second = written(spark, _answered(asked.mapInArrow(send_phrases, _MESSAGE_SCHEMA), _first_sources), "reference-phrases")

    fields = [
        ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("factors", pa.list_(pa.struct([(n, pa.int64()) for n in FACTOR]))), ("kept", pa.string()),
    ]
    fields = fields if keep_text else fields[:-1]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = Block(batch.column(1)[k].as_py(), width, name_bits)
                chosen = own.candidates(n_buckets, _as_dict(batch.column(2)[k].as_py()))
                sources, places = own.sources(batch.column(0)[k].as_py(), n_buckets, chosen, _as_dict(batch.column(3)[k].as_py()))
                out = []
                for doc, text in enumerate(own.texts):
                    a, b = own.words.first[doc], own.words.first[doc + 1]
                    parsed = factors(sources[a:b], places[a:b], width)
                    words = (text or "").encode("utf-8").split()
                    if parsed:
                        keep = np.ones(len(words), bool)
                        for start, length, _, _ in parsed:
                            keep[start : start + length] = False
                        words = list(itertools.compress(words, keep.tolist()))
                    kept = b" ".join(words)
                    row = [int(b - a), int(b - a) - len(words), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans(parsed)]]
                    out.append(row + [[dict(zip(FACTOR, f, strict=True)) for f in parsed]] + [kept.decode("utf-8")] * keep_text)
                columns = [list(c) for c in zip(*out, strict=True)]
                yield _rows([own.ids, *columns], [pa.int64(), *(t for _, t in fields)], [id_col, *(n for n, _ in fields)])

    every = (
        reference.select("block", "payload")
        .join(_by_block(first, "anchors"), "block", "left")
        .join(_by_block(second, "phrases"), "block", "left")
        .select("block", "payload", "anchors", "phrases")
    )
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    schema += f", factors array<struct<{','.join(f'{n}:long' for n in FACTOR)}>>"
    return every.mapInArrow(parse, schema + ", kept string" * keep_text)


def decoded(found: DataFrame, reference: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The words of every factor, read from its reference block: the id, ``start``, ``words``; to check a parse, or to show where a passage comes from.

    ``found``: what ``dedup`` gives with the same ``reference``.  A block comes before the factors that ask for it, so it is opened once."""
    asked = found.select(F.col(id_col).cast("long").alias("id"), F.explode("factors").alias("f"))
    asked = asked.select("f.block", F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("payload"), "id", "f.start", "f.place", "f.length")
    own = [F.lit(None).cast("long").alias(n) for n in asked.columns[3:]]
    rows = reference.select("block", F.lit(0).alias("turn"), "payload", *own).union(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        for batch in batches:
            out = []
            for k, turn in enumerate(batch.column(1).to_pylist()):
                if turn == 0:
                    texts = pa.ipc.open_stream(batch.column(2)[k].as_py()).read_all()["text"].to_pylist()
                    words = [w for t in texts for w in (t or "").encode().split()]
                else:
                    own, start, place, length = (batch.column(c)[k].as_py() for c in range(3, 7))
                    out.append([own, start, b" ".join(words[place : place + length]).decode()])
            yield _rows([list(c) for c in zip(*out, strict=True)] or [[], [], []], [pa.int64(), pa.int64(), pa.string()], [id_col, "start", "words"])

    return rows.repartition("block").sortWithinPartitions("block", "turn").mapInArrow(run, f"`{id_col}` long, start long, words string")
