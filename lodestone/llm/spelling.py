"""Spelling variant grouping: words one inserted, deleted or replaced letter apart, by rolling hashes of deletions.

1. Words of all texts are counted in tasks, some megabytes at a time, and the counts added up by word.
2. The words that are kept get ids in the order of preference (most frequent first, then by code points), so the best of some words is the least id.
3. Every word gives a key for each of its letters, the hash of the word without it, and one for the whole word.  A key is put together from polynomial hashes
   of the prefix and the suffix, 64-bit integers for all letters of many words at once.  Keys are dealt out by their leading digits (a radix partition) and
   sorted, and rows of equal key are compared by their strings, so equal hashes of unlike strings do no harm.
4. Words without the same letter at the same place and otherwise alike are replacements of each other; a word that is another one without a letter is a
   deletion of it.  Either group is at most as large as the alphabet times a word's length, so no key is hot; a group gives a word a count and the
   least id of the others, never pairs.
5. Forms are followed to their roots by doubling of pointers; a form is at least twice as frequent as the word, so 6 rounds follow any chain.

Strings of ``TRAVELS`` letters or more don't travel with their keys (a word of a million letters has a million of them); such candidates are compared by
joins with the words.

Defined results: a null or empty text has no words; a null id counts as an empty text before the colon; very long texts are counted whole, very long words
are words like others; repeated rows count as often as they occur; ties are broken as in 2; an empty table gives an empty table; other columns are not carried over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import mixed, random_u64
from lodestone.llm.common import group_starts, slices, whole_groups, written

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A run whose checksum this divides loses a letter.
DAMAGED = 97
#: A form is so many times as frequent as its word, at least.
RATIO = 2
COUNTED_BYTES = 8 << 20
#: Words keyed at once.
KEYED = 1 << 15
JUDGED_ROWS = 1 << 17
TRAVELS = 64
#: A run of more bytes has its checksum by the library, one by one.
LONG_RUN = 64
_LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), _LEAD]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = random_u64(256, 21)
_BASE = int(random_u64(1, 22)[0])
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, carried on from the checksum ``before``, all runs at once."""
    by = np.argsort(-np.minimum(size, LONG_RUN + 1).astype(np.int16), kind="stable")
    long = int(np.count_nonzero(size > LONG_RUN))
    register = ~before[by]
    at, left = start[by], size[by]
    until = np.searchsorted(-left[long:], -np.arange(LONG_RUN + 1), "left") + long  # how many are longer than k
    for k in range(LONG_RUN):
        m = int(until[k])
        if m == long:
            break
        part = register[long:m]
        register[long:m] = _CRC[(part ^ data[at[long:m] + k]) & 0xFF] ^ part >> 8
    out = np.empty(len(size), np.uint32)
    out[by] = ~register
    for k in by[:long].tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(before[k]))
    return out


def _words(texts: list[str | None], ids: list) -> pa.Array:
    """The words of texts, one letter a byte (ISO 8859-1), some of them damaged."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    lead = data == _LEAD
    inside = _LETTER[data]
    inside[1:] |= lead[:-1]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.append(0, edge)
    start, end = edge[0::2], edge[1::2]
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    own = np.repeat(before, np.diff(np.searchsorted(start, begins)))
    check = _checksums(data, start, end - start, own)
    # one byte a letter, without what stands between runs
    letters = np.add(data, 0x40, out=data.copy(), where=np.append(False, lead[:-1]))[inside & ~lead]
    seen = np.cumsum(lead)
    length = end - start - (seen[end - 1] - np.where(start > 0, seen[start - 1], 0))
    hurt = np.flatnonzero(check % DAMAGED == 0)
    keep = np.ones(len(letters), bool)
    keep[(np.cumsum(length) - length)[hurt] + check[hurt] % length[hurt]] = False
    length[hurt] -= 1
    return _array(letters[keep], length)


def _array(letters: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word``, ``n``: the words of all texts that are long and frequent enough."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in slices(batch.column(1), COUNTED_BYTES, 1 << 16):
                words = _words(batch.column(1).slice(at, rows).to_pylist(), batch.column(0).slice(at, rows).to_pylist())
                found = words.filter(pc.greater_equal(pc.binary_length(words), least_length)).value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["letters", "n"])

    found = kept.mapInArrow(run, "letters binary, n long").groupBy("letters").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    return found.select(F.decode("letters", "ISO-8859-1").alias("word"), "n")


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter of all words, and how many letters each has."""
    words = pa.concat_arrays([words])  # without what a slice leaves out
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lead = data == _LEAD
    letters = np.add(data, 0x40, out=data.copy(), where=np.append(False, lead[:-1]) if len(lead) else lead)[~lead]
    place = np.append(0, np.cumsum(~lead))
    return letters, np.diff(place[offsets - offsets[0]])


def _keys(letters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, letter left out or -1) for every letter of every word and every whole word."""
    end = np.cumsum(length)
    start = end - length
    power = np.full(len(letters) + 1, _BASE, np.uint64)
    back = np.full(len(letters) + 1, _BACK, np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    prefix = np.append(np.uint64(0), np.cumsum(_VALUES[letters] * power[:-1]))
    word = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(letters))
    s, e = start[word], end[word]
    without = ((prefix[place] - prefix[s]) + (prefix[e] - prefix[place + 1]) * _BACK) * back[s]
    whole = (prefix[end] - prefix[start]) * back[start]
    key = np.concatenate((mixed(without + (length[word] - 1).astype(np.uint64)), mixed(whole + length.astype(np.uint64))))
    return key, np.append(word, np.arange(len(length))), np.append(place - s, np.full(len(length), -1))


def _keyed(words: DataFrame) -> DataFrame:
    """``key``, ``place``, ``id``, ``word`` (null where the string without the letter is long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in slices(batch.column(1), KEYED * 16, KEYED):
                ids, own = batch.column(0).slice(at, rows), batch.column(1).slice(at, rows)
                letters, length = _letters(own)
                key, word, place = _keys(letters, length)
                left = length[word] - (place >= 0)
                travels = pa.array(np.where(left < TRAVELS, word, 0), mask=left >= TRAVELS)
                for k in range(0, len(key), 1 << 18):
                    cut = slice(k, k + (1 << 18))
                    columns = [pa.array(key[cut].view(np.int64)), pa.array(place[cut].astype(np.int32)), ids.take(pa.array(word[cut])), own.take(travels[cut])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "id", "word"])

    return words.select("id", "word").mapInArrow(run, "key long, place int, id long, word string")


_JUDGED = ["id", "n_near", "best", "other", "place"]


def _rows(id: np.ndarray, n_near: np.ndarray, best: np.ndarray, other: np.ndarray | None = None, place: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [pa.array(id), pa.array(n_near), pa.array(best)]
    columns += [pa.array(x) if x is not None else pa.nulls(len(id), pa.int64()) for x in (other, place)]
    return pa.RecordBatch.from_arrays(columns, names=_JUDGED)


def _others(group: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted groups of distinct ids, sorted too: each id, how many others there are, the least of them."""
    starts = group_starts(group)
    sizes = np.diff(starts, append=len(group))
    first = np.repeat(starts, sizes)
    at = np.arange(len(group))
    second = id[np.minimum(first + 1, len(id) - 1)]
    return id, np.repeat(sizes, sizes) - 1, np.where(at == first, second, id[first])


def _deletions(group: np.ndarray, place: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole word's id, longer word's id, the letter left out) of groups sorted by group, place and id: each pair once."""
    whole = np.flatnonzero(place < 0)
    of = np.full(int(group.max()) + 1 if len(group) else 0, -1)
    of[group[whole]] = id[whole]
    longer = np.flatnonzero((place >= 0) & (of[group] >= 0))
    longer = longer[np.lexsort((place[longer], id[longer], group[longer]))]
    longer = longer[group_starts(group[longer], id[longer])] if len(longer) else longer
    return of[group[longer]], id[longer], place[longer]


def _judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Counts and bests of the words in rows of equal keys; candidates (``other``, ``place``) where no string came along."""
    key = table["key"].to_numpy()
    starts = group_starts(key)
    sizes = np.diff(starts, append=len(key))
    table = table.filter(pa.array(np.repeat(sizes > 1, sizes)))
    bare = table["word"].is_null()
    some = table.filter(pc.invert(bare)).combine_chunks()
    if some.num_rows:
        place, id = some["place"].to_numpy().astype(np.int64), some["id"].to_numpy()
        letters, length = _letters(some["word"].combine_chunks() if some["word"].num_chunks != 1 else some["word"].chunk(0))
        keep = np.ones(len(letters), bool)
        keep[((np.cumsum(length) - length) + place)[place >= 0]] = False
        group = _array(letters[keep], length - (place >= 0)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.lexsort((id, place, group))
        group, place, id = group[by], place[by], id[by]
        alike = np.flatnonzero(place >= 0)
        names = group[alike] * (int(place.max()) + 1) + place[alike]
        one, n, best = _others(names, id[alike]) if len(alike) else (np.empty(0, np.int64),) * 3
        one, n, best = one[n > 0], n[n > 0], best[n > 0]
        short, long, _ = _deletions(group, place, id)
        every = np.concatenate((one, short, long))
        n, best = np.concatenate((n, np.ones(2 * len(short), np.int64))), np.concatenate((best, long, short))
        if len(every):
            by = np.argsort(every, kind="stable")
            cuts = group_starts(every[by])
            yield _rows(every[by][cuts], np.add.reduceat(n[by], cuts), np.minimum.reduceat(best[by], cuts))
    rest = table.filter(bare).combine_chunks()
    if rest.num_rows:
        key, place, id = rest["key"].to_numpy(), rest["place"].to_numpy().astype(np.int64), rest["id"].to_numpy()
        group = np.unique(key, return_inverse=True)[1]
        by = np.lexsort((id, place, group))
        group, place, id = group[by], place[by], id[by]
        short, long, at = _deletions(group, place, id)
        pairs = [(a, b, p) for a, b, p in zip(short.tolist(), long.tolist(), at.tolist(), strict=True)]
        starts = group_starts(group, place)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            if place[a] >= 0:
                pairs += [(int(id[i]), int(id[j]), int(place[a])) for i in range(a, b) for j in range(i + 1, b)]
        if pairs:
            a, b, p = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
            yield _rows(a, np.ones(len(a), np.int64), b, b, p)


def _near(words: DataFrame) -> DataFrame:
    """``id``, ``n_near``, ``best``: how many words are near each one that has any, and the least id of these."""
    spark = words.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"], JUDGED_ROWS):
            yield from _judge(table)

    dealt = _keyed(words).repartition(F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")
    judged = written(spark, dealt.mapInArrow(run, "id long, n_near long, best long, other long, place long"), "near-words")
    # those whose strings stayed behind
    w = words.select("id", "word")
    pairs = judged.filter("other IS NOT NULL").select("id", "other", "place").distinct()
    pairs = pairs.join(w, "id").join(w.select(F.col("id").alias("other"), F.col("word").alias("longer")), "other")
    cut = "concat(substring(longer, 1, int(place)), substring(longer, int(place) + 2))"
    pairs = pairs.filter(f"CASE WHEN length(word) < length(longer) THEN word ELSE concat(substring(word, 1, int(place)), substring(word, int(place) + 2)) END = {cut}")
    pairs = pairs.select("id", "other").distinct()
    both = pairs.selectExpr("id", "1L AS n_near", "other AS best").union(pairs.selectExpr("other AS id", "1L AS n_near", "id AS best"))
    return judged.filter("other IS NULL").select("id", "n_near", "best").union(both).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``id``, ``root`` of words with a form, from ``id``, ``form``: each round follows twice as far."""
    spark, held = forms.sparkSession, forms.selectExpr("id", "form AS root")
    while True:
        held = written(spark, held, "roots")
        further = held.alias("h").join(held.selectExpr("id AS root", "root AS further").alias("f"), "root", "left")
        if not further.filter("further IS NOT NULL").limit(1).count():
            return held
        held = further.selectExpr("id", "coalesce(further, root) AS root")


def variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of a table of distinct words of letters to U+00FF and their counts (``word``, ``n``)."""
    spark = words.sparkSession
    held = written(spark, words.select("word", F.col("n").cast("long").alias("n")), "counted-words")
    held = written(spark, held.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "ranked-words")
    other = held.selectExpr("id AS best", "word AS best_word", "n AS best_n")
    found = held.join(_near(held), "id", "left").join(other, "best", "left")
    linked = F.col("best_n") >= F.col("n") * ratio
    found = found.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *(F.when(linked, F.col(c)).alias(n) for c, n in (("best", "form_id"), ("best_word", "form"), ("best_n", "form_n"))),
    )
    found = written(spark, found, "word-forms")
    roots = _roots(found.filter("form_id IS NOT NULL").selectExpr("id", "form_id AS form"))
    named = roots.join(held.selectExpr("id AS root", "word AS root_word"), "root").select("id", "root_word")
    put = found.join(named, "id", "left")
    return put.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
