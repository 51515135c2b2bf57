"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file (BPE with byte fallback) or from pieces with log-probabilities (``compile_unigram``), three transducers are
composed with each input:

* the normaliser: rewriting rules, leftmost and longest first, and the mark before a text (``Normaliser``);
* the pieces: a trie with an arc for each piece, of the piece's weight, and for each character without a piece a chain of arcs
  that write its bytes, one arc a byte;
* for BPE, the pair acceptor: its states are pieces, and an arc from piece ``a`` to piece ``b`` weighs 0 if BPE leaves ``a`` beside
  ``b``, infinity if BPE would have merged across their boundary.

Encoding is the tropical shortest path of the composition: in the order of their places, states relax the arcs that leave them (the sum along
a path, the least over paths), and back pointers give the pieces.  In a unigram model a piece weighs minus its log-probability, and
many paths are finite.  In a BPE model pieces weigh 0: a sequence of pieces is the BPE segmentation of its text if and only if each
neighbouring pair is one that BPE leaves (its merges go by rank, so a merge that crosses a boundary shows in the pair around it); so of all
arcs that enter a state exactly one is on a path of finite weight, and knowing the last piece of a state is knowing the acceptor's state.
Whether a pair weighs 0 follows by undoing its merges, latest first, and looking for a merge across the boundary that would have come earlier.

Pieces never hold a mark behind another character, so units (a run of spaces and what follows it) are independent: each
distinct unit of a batch is composed once, all units together by numpy; a unit longer than ``LONG`` bytes is composed by itself.
Runs of two marks or more are pieces of one rank; they are segmented by a table over the run's length.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; very long texts are encoded
whole; a mark in the text decodes to a space, every other text decodes to itself; equal texts get equal ids; an empty
table gives an empty table; columns other than the id and the text are not carried over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import Words
from lodestone.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes from which a unit is composed by itself.
LONG = 96
SLICE_BYTES = 1 << 19
#: Distinct units whose ids a task remembers.
REMEMBERED = 1 << 19
_SPACE, _LINE = 0x20, 0x0A
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """A hash table from pairs of numbers to a number, looked up by arrays."""

    def __init__(self, items: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(items)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int32)
        self.probes = 1
        for (a, b), value in items.items():
            key = a << 32 | b
            at = (key * int(_MULTIPLIER) & (1 << 64) - 1) >> int(self.shift)
            n = 1
            while self.keys[at] != -1:
                at, n = at + 1, n + 1
            self.keys[at], self.values[at] = key, value
            self.probes = max(self.probes, n)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = ((key.view(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == key, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] != -1))
        for n in range(1, self.probes):
            if not len(open_):
                break
            own = at[open_] + n
            hit = self.keys[own] == key[open_]
            out[open_[hit]] = self.values[own[hit]]
            open_ = open_[~hit & (self.keys[own] != -1)]
        return out


def _merged(text: str, rank: dict[str, int]) -> list[str]:
    """BPE by its definition: the merge of the best rank first, the leftmost of these."""
    parts = list(text)
    while True:
        found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


class Normaliser:
    """A transducer of rewriting rules, leftmost and longest first; what no rule matches is copied, and ``before`` is put before a text."""

    def __init__(self, rules: dict[str, str], before: str):
        self.rules, self.before = {k.encode("utf-8"): v.encode("utf-8") for k, v in rules.items()}, before.encode("utf-8")
        self.machine = re.compile(b"|".join(map(re.escape, sorted(self.rules, key=len, reverse=True))))

    def __call__(self, text: str) -> bytes:
        data = text.encode("utf-8")
        return self.before + (self.machine.sub(lambda m: self.rules[m[0]], data) if self.rules else data)


@dataclass
class Transducer:
    """``rank``, ``left``, ``right``: of each piece, the order of its merge and the pieces merged (-1: a character).

    ``weight``: of each piece's arc; ``fallback``: of a chain of bytes, on its first arc.  ``merges``: None where every pair fits."""

    normaliser: Normaliser
    pieces: list[bytes]
    weight: np.ndarray
    fallback: float
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merges: Pairs | None
    trie: np.ndarray
    final: np.ndarray
    bytes_from: int
    mark: int
    runs: list[list[int]]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pair acceptor's arc from ``a`` to ``b`` weighs 0; a piece below 0 is a unit's edge."""
        out = np.ones(len(a), bool)
        if self.merges is None:
            return out
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        limit = np.full(len(at), np.iinfo(np.int32).max, np.int32)
        while len(at):
            across = self.merges.get(a, b)
            bad = (across >= 0) & (across < limit)
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            keep = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[keep], a[keep], b[keep], ra[keep], rb[keep]
            first = ra > rb  # the later merge is undone; of equal ones the right
            limit = np.where(first, ra, rb + 1).astype(np.int32)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def run(self, n: int) -> list[int]:
        """The pieces of ``n`` marks."""
        longest = len(self.runs) - 1
        return self.runs[longest] * (n // longest) + self.runs[n % longest]

    # the composition with units

    def paths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the units ``data[start:end]``, one after the other, and how many each has."""
        size = end - start
        base = (np.cumsum(size + 1) - (size + 1)).astype(np.int32)  # states of a unit: one more than it has bytes
        n = int((size + 1).sum())
        unit = np.repeat(np.arange(len(size), dtype=np.int32), size)
        offset = (np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        byte = data[start[unit] + offset]
        state = base[unit] + offset
        begins = (byte & 0xC0) != 0x80
        length = np.array([1] * 12 + [2] * 2 + [3, 4], np.int32)[byte >> 4]
        padded = np.zeros(n + 1, np.uint8)
        padded[state] = byte
        # arcs of the pieces: all walks down the trie at once
        source = state[begins]
        stop = (base + size.astype(np.int32))[unit[begins]]
        single = source + np.minimum(length[begins], stop - source)
        known = np.zeros(len(source), bool)
        arcs = []
        alive, node, to = np.arange(len(source), dtype=np.int32), np.zeros(len(source), np.int32), source.copy()
        while len(alive):
            node = self.trie[np.minimum(node, len(self.trie) - 1), padded[to]]
            go = node > 0
            alive, node, to = alive[go], node[go], to[go] + 1
            piece = self.final[node]
            hit = piece >= 0
            known[alive[hit & (to == single[alive])]] = True
            arcs.append((source[alive[hit]], to[hit], piece[hit]))
            go = to < stop[alive]
            alive, node, to = alive[go], node[go], to[go]
        # byte fallback: a chain of arcs, one a byte, for a character without a piece
        width = (single - source)[~known]
        inner = np.arange(int(width.sum()), dtype=np.int32) - np.repeat(np.cumsum(width) - width, width).astype(np.int32)
        chain = np.repeat(source[~known], width) + inner
        arcs.append((chain, chain + 1, self.bytes_from + padded[chain].astype(np.int32)))
        cost = [self.weight[p] for _, _, p in arcs[:-1]] + [np.where(inner == 0, self.fallback, 0.0)]
        tail, head, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        cost = np.concatenate(cost)
        # the shortest path: states relax their arcs in the order of their place in the unit; no two arcs of a place enter one state
        place = (tail - np.repeat(base, size + 1)[tail]).astype(np.uint16)  # units are short
        order = np.argsort(place, kind="stable")
        tail, head, piece, cost = tail[order], head[order], piece[order], cost[order]
        cuts = np.searchsorted(place[order], np.arange((int(place.max()) if len(place) else -1) + 2))
        last, back, dist = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, np.inf)
        dist[base] = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            t, h, p = tail[a:b], head[a:b], piece[a:b]
            total = dist[t] + cost[a:b]
            nearer = (total < dist[h]) & self.fits(last[t], p)
            h = h[nearer]
            dist[h], last[h], back[h] = total[nearer], p[nearer], t[nearer]
        on = np.zeros(n, bool)
        at = (base + size)[size > 0]
        while len(at):
            on[at] = True
            at = back[at]
            at = at[back[at] >= 0]
        owner = np.repeat(np.arange(len(size)), size + 1)
        return last[on], np.bincount(owner[on], minlength=len(size))

    def path(self, unit: bytes) -> list[int]:
        """Pieces of one unit, however long: the same composition, state by state."""
        n = len(unit)
        last, back, dist, seen = [-1] * (n + 1), [-1] * (n + 1), [0.0] + [float("inf")] * n, {}

        def relax(at: int, to: int, piece: int, cost: float) -> None:
            pair = (last[at], piece)
            if pair not in seen:
                seen[pair] = bool(self.fits(np.array(pair[:1]), np.array(pair[1:]))[0])
            if seen[pair] and dist[at] + cost < dist[to]:
                last[to], back[to], dist[to] = piece, at, dist[at] + cost

        for at in range(n):
            if unit[at] & 0xC0 == 0x80:
                continue
            width = next(w for w, most in ((1, 0x80), (2, 0xE0), (3, 0xF0), (4, 0x100)) if unit[at] < most)
            node, known = 0, False
            for to in range(at + 1, n + 1):
                node = int(self.trie[min(node, len(self.trie) - 1), unit[to - 1]])
                if not node:
                    break
                piece = int(self.final[node])
                if piece >= 0:
                    known |= to == at + width
                    relax(at, to, piece, float(self.weight[piece]))
            if not known:
                for k in range(at, at + width):
                    relax(k, k + 1, self.bytes_from + unit[k], self.fallback if k == at else 0.0)
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def encode(self, texts: list[str | None], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has; ``memory``: units composed before."""
        parts = [self.normaliser(t) if t else b"" for t in texts]
        data = np.frombuffer(b"".join(parts) or b"\0", np.uint8)
        begins = np.cumsum([0, *map(len, parts)])
        if begins[-1] == 0:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        space = data == _SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut |= data == _LINE
        cut[begins[:-1][np.diff(begins) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        hashes = Words(data, start, end, np.array([0, len(start)])).hashes()
        names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        memory = memory if memory is not None else Memory()
        new = np.flatnonzero(~memory.knows(names))
        memory.add(names[new], *self._units(data, start[first[new]], end[first[new]]))
        ids, offset, counts = memory.of(names)
        n = counts[which]
        flat = ids[np.repeat(offset[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate(([0], np.cumsum(n)))
        return flat.astype(np.int32), np.diff(total[np.searchsorted(start, begins)])

    def _units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``paths``, for units with any run of spaces before them."""
        lead = np.zeros(len(start), np.int64)
        open_ = np.flatnonzero(data[start] == _SPACE)
        while len(open_):
            lead[open_] += 1
            open_ = open_[start[open_] + lead[open_] < end[open_]]
            open_ = open_[data[start[open_] + lead[open_]] == _SPACE]
        inner = start + np.maximum(lead - 1, 0)  # the last space goes with what follows
        odd = (lead > 1) | (end - inner > LONG)
        plain = np.flatnonzero(~odd)
        ids, counts = self.paths(data, inner[plain], end[plain])
        if not odd.any():
            return ids, counts
        found: dict[int, list[int]] = {}
        for k in np.flatnonzero(odd).tolist():
            text, marks = data[inner[k] : end[k]].tobytes(), max(0, int(lead[k]) - 1)
            own = self.path(text)
            if marks and own[:1] == [self.mark]:
                own, marks = own[1:], marks + 1
            found[k] = self.run(marks) + own if marks else own
        every = np.zeros(len(start), np.int64)
        every[plain] = counts
        every[list(found)] = [len(x) for x in found.values()]
        offset = np.cumsum(every) - every
        out = np.empty(int(every.sum()), np.int64)
        out[np.repeat(offset[plain] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        for k, x in found.items():
            out[offset[k] : offset[k] + len(x)] = x
        return out, every

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ``counts`` ids each; bytes that are not UTF-8 become U+FFFD."""
        sizes = np.array([len(p) for p in self.pieces])
        pool = np.frombuffer(b"".join(self.pieces), np.uint8)
        at = np.cumsum(sizes) - sizes
        n = sizes[ids]
        flat = pool[np.repeat(at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        # the mark before the text is dropped
        return [flat[a + (flat[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


class Memory:
    """Ids of units by the units' hashes; it forgets all but the newest units beyond ``REMEMBERED``."""

    def __init__(self):
        self.names, self.at, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def knows(self, names: np.ndarray) -> np.ndarray:
        if len(self.names) > REMEMBERED:
            self.__init__()
        if not len(self.names):
            return np.zeros(len(names), bool)
        return self.names[np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)] == names

    def add(self, names: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        at = np.concatenate((self.at, len(self.ids) + np.cumsum(counts) - counts))
        self.names, self.counts = np.concatenate((self.names, names)), np.concatenate((self.counts, counts))
        order = np.argsort(self.names, kind="stable")
        self.names, self.at, self.counts = self.names[order], at[order], self.counts[order]
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def of(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each name begin and how many they are."""
        place = np.searchsorted(self.names, names)
        return self.ids, self.at[place], self.counts[place]


def compile_model(path: str = MODEL) -> Transducer:
    """From a model file: BPE, identity normalisation, byte fallback; another kind is an error."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(k) for k in range(n)]
    byte_ids = [k for k in range(n) if model.is_byte(k)]
    if len(byte_ids) != 256 or byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
        raise ValueError("the model has no byte fallback")
    special = {k for k in range(n) if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k)}
    usual = [k for k in range(n) if k not in special]
    if any(MARK in names[k].lstrip(MARK) for k in usual):
        raise ValueError("a piece holds a mark behind another character")
    if any("\n" in names[k] for k in usual):
        raise ValueError("a piece holds a line feed; units end there")
    # equal scores are one rank: the leftmost merge goes first
    score = {names[k]: model.get_score(k) for k in usual}
    places = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    rank_of = {p: places[s] for p, s in score.items()}
    number = {names[k]: k for k in usual}
    rank, left, right = (np.full(n, -1, np.int32) for _ in range(3))
    merges, reached = {}, set()
    for p in sorted(number, key=len):
        k = number[p]
        if len(p) == 1:
            reached.add(k)
            continue
        # the last merge of the piece joins the two parts that are left without it
        parts = _merged(p, _without(rank_of, p))
        if len(parts) == 2 and all(number.get(q) in reached for q in parts):
            rank[k], left[k], right[k] = rank_of[p], number[parts[0]], number[parts[1]]
            reached.add(k)
        for cut in range(1, len(p)):
            if p[:cut] in number and p[cut:] in number:
                merges[number[p[:cut]], number[p[cut:]]] = rank_of[p]
    text = lambda k: names[k].replace(MARK, " ").encode("utf-8")
    # runs have their own table
    trie, final = _trie({k: text(k) for k in sorted(reached) if len(names[k]) == 1 or set(names[k]) != {MARK}})
    longest = max(len(p) for p in number if set(p) == {MARK})
    runs = [[number[q] for q in _merged(MARK * k, rank_of)] for k in range(longest + 1)]
    pieces = [b"" if k in special else text(k) for k in range(n)]
    for value, k in enumerate(byte_ids):
        pieces[k] = bytes([value])
    made = Transducer(Normaliser({MARK: " "}, " "), pieces, np.zeros(n), 0.0, rank, left, right, Pairs(merges), trie, final, byte_ids[0], number[MARK], runs)
    probe = "a  b\u00e9 e\u0301 \ufb01\u2460\u00a0\uff21"
    if model.encode(probe, out_type=int) != made.encode([probe])[0].tolist():
        raise ValueError("the model is not BPE with identity normalisation and a mark before the text")
    return made


def compile_unigram(scores: dict[str, float], rules: dict[str, str] | None = None, penalty: float = 10.0) -> Transducer:
    """From pieces and their log-probabilities: ids 0 to 255 are the bytes, then the mark, then the pieces in their order.

    The mark is a piece by itself if it has no score (then it weighs as a chain of bytes does): the least score less ``penalty``."""
    if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) or "\n" in p or not p for p in scores):
        raise ValueError("a piece is empty, or holds a line feed, or a mark that is not its first character")
    names = [MARK, *(p for p in scores if p != MARK)]
    pieces = [bytes([x]) for x in range(256)] + [p.replace(MARK, " ").encode("utf-8") for p in names]
    fallback = penalty - min(scores.values(), default=0.0)
    weight = np.array([fallback] * 256 + [-scores[p] if p in scores else fallback for p in names])
    none = np.full(len(pieces), -1, np.int32)
    trie, final = _trie({256 + k: pieces[256 + k] for k in range(len(names))})
    return Transducer(Normaliser({MARK: " ", **(rules or {})}, " "), pieces, weight, fallback, none, none, none, None, trie, final, 0, 256, [[], [256]])


def _trie(texts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes x bytes (0: no arc), and the piece that ends at each node (-1: none)."""
    rows, final = [{}], [-1]
    for k, data in texts.items():
        node = 0
        for x in data:
            if x not in rows[node]:
                rows[node][x] = len(rows)
                rows.append({})
                final.append(-1)
            node = rows[node][x]
        final[node] = k
    # inner nodes come first; all leaves share the last row, which is empty
    inner = [k for k, row in enumerate(rows) if row]
    order = {k: n for n, k in enumerate(inner + [k for k, row in enumerate(rows) if not row])}
    trie = np.zeros((len(inner) + 1, 256), np.int32)
    for k in inner:
        for x, to in rows[k].items():
            trie[order[k], x] = order[to]
    return trie, np.array([final[k] for k in order], np.int32)


class _without(dict):
    """A view of ranks that lacks one piece."""

    def __init__(self, ranks: dict[str, int], gone: str):
        super().__init__()
        self.ranks, self.gone = ranks, gone

    def __contains__(self, p) -> bool:
        return p != self.gone and p in self.ranks

    def __getitem__(self, p) -> int:
        return self.ranks[p]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """A row per document: the id, ``n_tokens``, ``ids`` and, with ``decode``, ``decoded``, the text read back from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_model(model))  # bounded by the vocabulary
    kept = docs.select(id_col, text_col)
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            for at, n in slices(batch.column(1), SLICE_BYTES, 1 << 20):
                part = batch.slice(at, n)
                texts = part.column(1).to_pylist()
                ids, counts = shared.value.encode(texts, memory)
                gone = np.array([t is None for t in texts])
                columns = [pa.array(counts, pa.int64(), mask=gone), _lists(ids, counts, gone)]
                if decode:
                    back = shared.value.decode(ids, counts)
                    columns.append(pa.array([None if x else t for x, t in zip(gone.tolist(), back, strict=True)], pa.string()))
                names = [id_col, "n_tokens", "ids", "decoded"][: 1 + len(columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>" + ", decoded string" * decode)


def _lists(ids: np.ndarray, counts: np.ndarray, gone: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(gone, False)), pa.array(ids, pa.int32()))


def decode(tokens: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row per row: the id and ``text``; null ids are a null text, null elements and ids outside the vocabulary are errors."""
    shared = tokens.sparkSession.sparkContext.broadcast(compile_model(model))
    kept = tokens.select(id_col, F.col(ids_col).cast("array<int>").alias("ids"))
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = np.asarray(lists.value_lengths().fill_null(0))
            texts = shared.value.decode(lists.flatten().to_numpy(), counts)
            gone = lists.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if g else t for g, t in zip(gone, texts, strict=True)], pa.string())],
                names=[id_col, "text"],
            )

    return kept.mapInArrow(run, f"`{id_col}` {kind}, text string")
