"""Cross-tokenizer alignment: a transducer over dangling suffixes cuts two token sequences of a text where both end.

A state is which side leads and the bytes by which it leads; the next token is read from the other side, and the transition, which compares
the two, is made once and remembered under the state and the token.  A state without bytes closes a group.  The same bytes on both sides are a condition: where they differ a
text has no tokens.

Both tokenizers cut before a space between two characters that are not white space, so no side leads there: texts are split into such units, each distinct unit is encoded and run through the
transducer once (many together, as one text), and its groups are remembered.  Tokenizers that don't cut there get whole texts.

Links are all pairs of tokens of a group.  An id pair's count is the number of documents, of the whole corpus, in which it is linked:

1. Documents are encoded and aligned in blocks of ``BLOCK_BYTES``.  A block keeps, of each document, the numbers of its pairs among the block's distinct
   pairs and how often each is linked, and how many of its documents hold each pair.
2. Blocks send these counts to buckets by the first id; they are summed over shelves of ``SHELF`` blocks first, then over the shelves, so
   the pair that every block has is one entry a shelf.  A bucket has all pairs of an id and marks those of the highest count.
3. Sums go back to the shelves, and from each shelf to its blocks, which add them up for their documents.

Texts are encoded once and stay where they are.  There are at most vocabulary x vocabulary pairs, so ``MOST_BUCKETS`` buckets hold a bounded number each.

Defined results: a null or an empty text has no tokens and no group (its digest is an empty string), nor has one whose joined tokens are not a space and the
text; very long texts are aligned whole, unit by unit; repeated rows are documents
of their own, each counts; a null id is an id like others; an empty table gives an empty table; columns other than the id and the text are not carried over.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import mixed
from lodestone.llm.common import group_starts, slices, whole_groups, written

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed value: the pattern by which byte-level BPE of this family splits texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
#: Letters of units that are encoded together.
TOGETHER = 1 << 18
SHELF = 256
LEAST_BUCKETS, MOST_BUCKETS = 32, 4096
#: Transitions and units that are remembered, and letters of units.
REMEMBERED = 1 << 19
REMEMBERED_LETTERS = 1 << 24
#: Links of a group that are written out one by one; a larger group is counted by its distinct ids.
WRITTEN_OUT = 1 << 12
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ByteTokens:
    """Byte-level BPE of a ``tokenizers`` file: ids of texts, bytes of ids.

    Where the file's merges come in the order of their ids, ``tiktoken`` gives the same ids in a fifth of the time."""

    def __init__(self, data: bytes):
        model = json.loads(data)
        vocabulary, special = model["model"]["vocab"], {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        letters = _byte_letters()
        self.bytes = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        for token, k in special.items():
            self.bytes[k] = token.encode()
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        split = model["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        if plain and model.get("normalizer") is None and made == sorted(set(made)) and len(made) + 256 == len(vocabulary) - len(set(special) & set(vocabulary)):
            import tiktoken

            ranks = {self.bytes[k]: k for token, k in vocabulary.items() if token not in special}
            encoding = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = encoding.encode_ordinary
        else:
            import tokenizers

            slow = tokenizers.Tokenizer.from_str(data.decode())
            slow.encode_special_tokens = True
            self.encode = lambda text: slow.encode(text, add_special_tokens=False).ids
        self.local = plain


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceTokens:
    """A ``sentencepiece`` model that puts a space before a text: ids of a text given with that space, bytes of ids."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(names)]
        probe = "a  bé e\u0301 ﬁ① Ａ "
        kept = b"".join(self.bytes[k] for k in self.model.encode(probe)) == b" " + probe.encode()
        # no piece goes on over a space, and the text is taken as it is
        self.local = kept and not any(MARK in p.lstrip(MARK) for p in names)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


class State(dict):
    """Next states by token: ``rest`` are the bytes by which one side leads, ``ahead`` says whether that is the first."""

    __slots__ = ("machine", "rest", "ahead")

    def __init__(self, machine: Transducer, rest: bytes, ahead: bool):
        self.machine, self.rest, self.ahead = machine, rest, ahead

    def __missing__(self, token: int) -> State:
        self[token] = found = self.machine.follow(self, token)
        return found


class Transducer:
    """Cuts two sequences of tokens into groups; states and transitions are made as they are met."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.first, self.second = first, second
        self.forget()

    def forget(self) -> None:
        self.start = State(self, b"", False)
        self.states = {(b"", False): self.start}
        self.made = 0

    def follow(self, state: State, token: int) -> State | None:
        """The state after ``token``, None if its bytes are not those that the other side has."""
        self.made += 1
        mine = (self.second if state.ahead else self.first)[token]
        if state.rest.startswith(mine):
            rest, ahead = state.rest[len(mine) :], state.ahead
        elif mine.startswith(state.rest):
            rest, ahead = mine[len(state.rest) :], not state.ahead
        else:
            return None
        name = (rest, ahead and bool(rest))
        if name not in self.states:
            self.states[name] = State(self, *name)
        return self.states[name]

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """Where each group ends in ``a`` and in ``b``; None if their bytes differ."""
        if self.made > REMEMBERED:
            self.forget()
        start, ends_a, ends_b = self.start, [], []
        i = j = 0
        n, m = len(a), len(b)
        while i < n:
            state = start[a[i]]
            i += 1
            while state is not start:
                if state is None:
                    return None
                if state.ahead:
                    if j == m:
                        return None
                    state = state[b[j]]
                    j += 1
                else:
                    if i == n:
                        return None
                    state = state[a[i]]
                    i += 1
            ends_a.append(i)
            ends_b.append(j)
        return (ends_a, ends_b) if j == m else None


@dataclass
class Aligned:
    """Of units or documents: ``stats`` (tokens of either side, groups, links; a row each), ``texts`` of their groups, and for each its distinct linked pairs
    (first id << shift | second id, sorted) from ``first`` on and how often each is linked.  ``good``: whether the two sides have the same bytes, those of the text."""

    stats: np.ndarray
    texts: list[bytes]
    first: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    good: np.ndarray


class Aligner:
    """Both tokenizers, the transducer over their bytes, and the units that were aligned."""

    def __init__(self, first: bytes, second: bytes):
        self.a, self.b = ByteTokens(first), PieceTokens(second)
        self.machine = Transducer(self.a.bytes, self.b.bytes)
        self.shift = max(1, (len(self.b.bytes) - 1).bit_length())
        self.sizes = tuple(np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        # what a token writes: its id and what follows it, within its side or at the end of it
        marks = [f"{k}{end}" for n, ends in ((len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")) for k in range(n) for end in ends]
        self.written = np.array([len(m) for m in marks])
        self.marks = np.array(marks, dtype=f"S{self.written.max()}").view(np.uint8).reshape(len(marks), -1)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.letters = 0
        self.known = self._none()

    def _none(self) -> Aligned:
        return Aligned(np.empty((0, 4), np.int64), [], np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

    def _units(self, units: list[str]) -> Aligned:
        """Units, each without the space before it, as one text; each by itself where that is not the same."""
        text = " " + " ".join(units)
        data = text.encode()
        a, b = self.a.encode(text), self.b.encode(text)
        found = self.machine.groups(a, b) if b"".join(map(self.a.bytes.__getitem__, a)) == data else None
        if found is None:
            if len(units) > 1:
                return self._joined([self._units([u]) for u in units])
            out = self._none()
            return Aligned(np.zeros((1, 4), np.int64), [b""], np.zeros(2, np.int64), out.pairs, out.times, np.zeros(1, bool))
        a, b, ends_a, ends_b = (np.array(x, np.int64) for x in (a, b, *found))
        # units of groups, by the bytes up to a group's end
        at = np.cumsum(self.sizes[0][a])[ends_a - 1]
        ends = np.cumsum([1 + len(u.encode()) for u in units])
        unit = np.searchsorted(ends, at)
        if not np.array_equal(at[np.searchsorted(at, ends)], ends):
            raise ValueError("a tokenizer does not cut between units")
        na, nb = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        count = lambda w: np.bincount(unit, w, len(units)).astype(np.int64)
        stats = np.stack([count(na), count(nb), np.bincount(unit, minlength=len(units)), count(na * nb)], 1)
        of, pairs, times = self._links(unit, a, b, ends_a, ends_b, na, nb)
        texts = self._texts(a, b, ends_a, ends_b, np.cumsum(stats[:, 0] + stats[:, 1]))
        return Aligned(stats, texts, np.searchsorted(of, np.arange(len(units) + 1)), pairs, times, np.ones(len(units), bool))

    def _texts(self, a, b, ends_a, ends_b, ends) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every unit, whose tokens end at ``ends``."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1] = last_b[ends_b - 1] = 1
        # the first side's tokens come behind the second's of earlier groups
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(np.append(0, ends_b[:-1]), np.diff(ends_a, prepend=0))] = 2 * a + last_a
        codes[np.arange(len(b)) + np.repeat(ends_a, np.diff(ends_b, prepend=0))] = 2 * (len(self.a.bytes) + b) + last_b
        size = self.written[codes]
        whole = self.marks[codes][np.arange(self.marks.shape[1]) < size[:, None]].tobytes()
        cuts = [0, *np.cumsum(size)[ends - 1].tolist()]
        return [whole[x : y - 1] for x, y in zip(cuts, cuts[1:], strict=False)]

    def _links(self, unit, a, b, ends_a, ends_b, na, nb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, how often it is linked there), by unit and pair."""
        n = na * nb
        small = np.flatnonzero(n <= WRITTEN_OUT)
        each = n[small]
        group = np.repeat(small, each)
        k = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        x, y = np.divmod(k, nb[group])
        of, pairs = unit[group], a[(ends_a - na)[group] + x] << self.shift | b[(ends_b - nb)[group] + y]
        times = np.ones(len(of), np.int64)
        for g in np.flatnonzero(n > WRITTEN_OUT).tolist():
            ia, ta = np.unique(a[ends_a[g] - na[g] : ends_a[g]], return_counts=True)
            ib, tb = np.unique(b[ends_b[g] - nb[g] : ends_b[g]], return_counts=True)
            pairs, times = np.append(pairs, (ia[:, None] << self.shift | ib).ravel()), np.append(times, (ta[:, None] * tb).ravel())
            of = np.append(of, np.full(len(ia) * len(ib), unit[g]))
        return _summed_within(of, pairs, times)

    @staticmethod
    def _joined(parts: list[Aligned]) -> Aligned:
        first = np.append(0, np.cumsum(np.concatenate([np.diff(p.first) for p in parts])))
        return Aligned(
            np.concatenate([p.stats for p in parts]), list(itertools.chain.from_iterable(p.texts for p in parts)), first,
            *(np.concatenate([getattr(p, n) for p in parts]) for n in ("pairs", "times", "good")),
        )

    def _learn(self, units: list[str]) -> None:
        """Aligns the units that are not known."""
        new = [u for u in dict.fromkeys(units) if u not in self.numbers]
        if not new:
            return
        # a unit that ends in white space, or holds the mark that stands for a space, may read differently before another one
        alone = [u for u in new if u[-1:].isspace() or MARK in u]
        apart = set(alone)
        groups, size = [[]], 0
        for u in new:
            if u not in apart:
                if size > TOGETHER:
                    groups.append([])
                    size = 0
                groups[-1].append(u)
                size += len(u)
        groups = [g for g in groups if g] + [[u] for u in alone]
        self.known = self._joined([self.known, *(self._units(g) for g in groups)])
        for u in itertools.chain.from_iterable(groups):
            self.numbers[u] = len(self.numbers)
            self.letters += len(u)

    def align(self, texts: list[str | None]) -> Aligned:
        """Documents; one without tokens has no groups."""
        if len(self.numbers) > REMEMBERED or self.letters > REMEMBERED_LETTERS:
            self.forget()
        split = _CUT.split if self.a.local and self.b.local else lambda text: [text]
        units = [split(t) if t else [] for t in texts]
        self._learn(list(itertools.chain.from_iterable(units)))
        known, n = self.known, len(texts)
        numbers = [np.fromiter(map(self.numbers.__getitem__, u), np.int64, len(u)) for u in units]
        good = np.array([bool(known.good[x].all()) for x in numbers])
        numbers = [x if g else x[:0] for x, g in zip(numbers, good.tolist(), strict=True)]
        texts = [b";".join(map(known.texts.__getitem__, x.tolist())) for x in numbers]
        every, doc = np.concatenate([*numbers, np.empty(0, np.int64)]), np.repeat(np.arange(n), [len(x) for x in numbers])
        stats = np.zeros((n, 4), np.int64)
        np.add.at(stats, doc, known.stats[every])
        counts = (known.first[1:] - known.first[:-1])[every]
        at = np.repeat(known.first[every] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        of, pairs, times = _summed_within(np.repeat(doc, counts), known.pairs[at], known.times[at])
        return Aligned(stats, texts, np.searchsorted(of, np.arange(n + 1)), pairs, times, good)


def _summed_within(of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (owner, key) and the sums of their counts."""
    if not len(keys):
        return of, keys, counts
    width = int(keys.max()).bit_length()
    by = np.argsort(of << width | keys) if width + int(of.max()).bit_length() < 64 else np.lexsort((keys, of))
    of, keys = of[by], keys[by]
    starts = group_starts(of, keys)
    return of[starts], keys[starts], np.add.reduceat(counts[by], starts)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys)
    starts = group_starts(keys[by])
    return keys[by][starts], np.add.reduceat(counts[by], starts)


def _packed(numbers: np.ndarray) -> bytes:
    """Differences of numbers, in as many bytes each as the largest needs, in planes of equal bytes, which compress well."""
    steps = np.diff(numbers, prepend=0)
    most = int(np.abs(steps).max()) if len(steps) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + steps.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    return np.cumsum(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T.copy().view(f"<i{width}").ravel(), dtype=np.int64)


@lru_cache(maxsize=1)
def _aligner(first: bytes, second: bytes) -> Aligner:
    return Aligner(first, second)


_STATS = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCK_SCHEMA = f"block long, {', '.join(f'{n} array<long>' for n in _STATS)}, groups_sha256 array<string>, pairs binary, docs binary, many binary, numbers binary, times binary"


def _blocks(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Encoded and aligned blocks: ids and digests of documents, ``pairs`` and in how many ``docs`` each is linked; ``many``, ``numbers``, ``times``: how
    many distinct pairs each document has, their numbers among ``pairs``, how often each is linked."""
    files = docs.sparkSession.sparkContext.broadcast((Path(first).read_bytes(), Path(second).read_bytes()))  # bounded by the vocabularies
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        n = 0
        for batch in batches:
            for at, rows in slices(batch.column(1), BLOCK_BYTES, 1 << 16):
                part = batch.slice(at, rows)
                found = [aligner.align(part.column(1).slice(a, size).to_pylist()) for a, size in slices(part.column(1), SLICE_BYTES, 1 << 16)]
                stats, every = np.concatenate([x.stats for x in found]), np.concatenate([x.pairs for x in found])
                digests = [hashlib.sha256(t).hexdigest() if t else "" for x in found for t in x.texts]
                block = TaskContext.get().partitionId() << 32 | n
                n += 1
                distinct, numbers, held = np.unique(every, return_inverse=True, return_counts=True)
                columns = [pa.array([block]), pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type))]
                columns += [pa.array([list(c)], pa.list_(pa.int64())) for c in stats.T]
                packed = [distinct, held, np.concatenate([np.diff(x.first) for x in found]), numbers, np.concatenate([x.times for x in found])]
                columns += [pa.array([digests], pa.list_(pa.string())), *(pa.array([_packed(x)], pa.binary()) for x in packed)]
                names = ["block", "ids", *_STATS, "groups_sha256", "pairs", "docs", "many", "numbers", "times"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, _BLOCK_SCHEMA.replace("block long,", f"block long, ids array<{kind}>,"))


_MESSAGE = "bucket int, shelf int, block long, pairs binary, docs binary, best binary"
_NAMES = [f.split()[0] for f in _MESSAGE.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _bucket(pairs: np.ndarray, shift: int, n_buckets: int) -> np.ndarray:
    return (mixed((pairs >> shift).astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    for table in whole_groups(batches, keys):
        starts = group_starts(*(table[k].to_numpy() for k in keys)).tolist()
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            yield table.slice(a, b - a)


def _counts(blocks: DataFrame, shift: int) -> DataFrame:
    """For each block and bucket the counts of the block's pairs, in their order, over all blocks (``docs``), and whether each is its first id's highest (``best``)."""
    spark = blocks.sparkSession
    n_blocks = blocks.count()
    n_buckets, n_shelves = max(LEAST_BUCKETS, min(MOST_BUCKETS, n_blocks)), math.ceil(n_blocks / SHELF)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, docs = _unpacked(pairs), _unpacked(docs)
                if len(pairs):
                    bucket = _bucket(pairs, shift, n_buckets)
                    by = np.argsort(bucket, kind="stable")
                    starts = group_starts(bucket[by]).tolist()
                    shelf = int(mixed(np.array([block], np.uint64))[0] % np.uint64(n_shelves))
                    cuts = [by[a:b] for a, b in zip(starts, [*starts[1:], len(by)], strict=True)]
                    yield _batch([(int(bucket[c[0]]), shelf, block, _packed(pairs[c]), _packed(docs[c]), None) for c in cuts])

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["bucket", "shelf"]):
            pairs, docs = (np.concatenate([_unpacked(x) for x in group[n].to_pylist()]) for n in ("pairs", "docs"))
            pairs, docs = _summed(pairs, docs)
            yield _batch([(group["bucket"][0].as_py(), group["shelf"][0].as_py(), None, _packed(pairs), _packed(docs), None)])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["bucket"]):
            each = [_unpacked(x) for x in group["pairs"].to_pylist()]
            pairs, docs = _summed(np.concatenate(each), np.concatenate([_unpacked(x) for x in group["docs"].to_pylist()]))
            starts = group_starts(pairs >> shift)
            best = docs == np.repeat(np.maximum.reduceat(docs, starts), np.diff(starts, append=len(pairs)))
            for k, own in enumerate(each):
                at = np.searchsorted(pairs, own)
                yield _batch([(group["bucket"][k].as_py(), group["shelf"][k].as_py(), None, _packed(own), _packed(docs[at]), np.packbits(best[at]).tobytes())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            out = []
            for bucket, shelf, block, pairs, docs, best in zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True):
                if block is None:  # the shelf's sums come before its blocks
                    held = (_unpacked(pairs), _unpacked(docs), np.unpackbits(np.frombuffer(best, np.uint8)))
                else:
                    at = np.searchsorted(held[0], _unpacked(pairs))
                    out.append((bucket, shelf, block, None, _packed(held[1][at]), np.packbits(held[2][at]).tobytes()))
            yield _batch(out)

    messages = blocks.select("block", "pairs", "docs").mapInArrow(send, _MESSAGE)
    shelves = messages.repartition("bucket", "shelf").sortWithinPartitions("bucket", "shelf").mapInArrow(shelve, _MESSAGE)
    sums = written(spark, shelves.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, _MESSAGE), "pair-counts")
    asked = sums.union(messages).repartition("bucket", "shelf").sortWithinPartitions("bucket", "shelf", F.asc_nulls_first("block"))
    return asked.mapInArrow(answer, _MESSAGE).groupBy("block").agg(F.collect_list(F.struct("bucket", "docs", "best")).alias("answers"))


def align(docs: DataFrame, first: str = BYTE_BPE, second: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``first``: a byte-level BPE file of the ``tokenizers`` library; ``second``: a ``sentencepiece`` model that puts a space before a text."""
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = written(spark, _blocks(kept, first, second), "aligned-blocks")
    shift = _aligner(Path(first).read_bytes(), Path(second).read_bytes()).shift
    counts = _counts(blocks, shift)
    n_buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, blocks.count()))
    kind = kept.schema["id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = {n: batch.column(n)[k] for n in batch.schema.names}
                pairs, many, numbers, times = (_unpacked(own[n].as_py()) for n in ("pairs", "many", "numbers", "times"))
                docs, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                bucket = _bucket(pairs, shift, n_buckets)
                by = np.argsort(bucket, kind="stable")
                first_of = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                for x in own["answers"].as_py() or []:
                    at = by[first_of[x["bucket"]] : first_of[x["bucket"] + 1]]
                    docs[at] = _unpacked(x["docs"])
                    best[at] = np.unpackbits(np.frombuffer(x["best"], np.uint8), count=len(at))
                of = np.repeat(np.arange(len(many)), many)
                columns = [own["ids"].values, *(own[n].values for n in _STATS), pa.array(_exact(of, times * best[numbers], len(many))), pa.array(_exact(of, times * docs[numbers], len(many))), own["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *_STATS, "n_best", "count_sum", "groups_sha256"])

    schema = f"id {kind}, {', '.join(f'{n} long' for n in _STATS)}, n_best long, count_sum long, groups_sha256 string"
    every = blocks.drop("docs").join(counts, "block", "left")
    return every.mapInArrow(finish, schema).withColumnRenamed("id", id_col)


def _exact(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers, which may be beyond what a double holds."""
    out = np.zeros(n, np.int64)
    if len(of):
        starts = group_starts(of)
        out[of[starts]] = np.add.reduceat(values, starts)
    return out
