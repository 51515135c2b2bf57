"""Decontamination, spelling variants and tokenizer alignment: edges, bounds and plain twins."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import alignment, decontamination, queries, spelling

EXTRA = "start long, `item_id` string, chunk int, row long, id string, word string, n long, key long, `a b` string"
DOCS = f"doc_id long, text string, {EXTRA}"
WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y", "w", 4, 5, "z") for i, t in rows], DOCS).repartition(3)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# 11


def contaminated(docs, items, width=10):
    """Every window of every item at every place of every document."""
    windows = []
    for item, text in items:
        w = WORDS.findall(lower(text))
        size = min(width, len(w))
        windows += [(item, w[k : k + size]) for k in range(len(w) - size + 1) if w]
    out = []
    for i, text in docs:
        w, hit, found = WORDS.findall(lower(text)), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def judged(spark, docs, items, **more):
    found = decontamination.contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in found), key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven"
ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "Short one!"), (4, None), (5, " .,; "), (None, "x1 Y2"), (3, "short ONE"), (7, "é ü 日本 ß" * 4)]
TEXTS = [
    (1, f"so: {PASSAGE.upper()}, {PASSAGE}"), (1, f"so: {PASSAGE.upper()}, {PASSAGE}"), (2, None), (3, ""), (None, "a SHORT--one; x1/y2"), (4, " ".join(PASSAGE.split()[:9])),
    (5, "lorem ipsum " * 30_000 + PASSAGE), (6, "shortone short on"), (7, "é ü 日本 ß" * 9), (8, "short"), (9, "one"),
]


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 20])
def test_decontamination(spark, chunk_bytes):
    assert judged(spark, TEXTS, ITEMS, chunk_bytes=chunk_bytes) == contaminated(TEXTS, ITEMS)


def test_random_decontamination(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs, items = [(k, text(rng.randint(0, 60))) for k in range(60)], [(k, text(rng.randint(0, 14))) for k in range(12)]
    for width in (1, 4, 10):
        assert judged(spark, docs, items, width=width, chunk_bytes=60) == contaminated(docs, items, width)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 20])
def test_clean_keeps_rows_and_columns(spark, chunk_bytes):
    docs, items = docs_of(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontamination.clean(docs, items, chunk_bytes=chunk_bytes)
    hit = {r[0] for r in contaminated(TEXTS, ITEMS) if r[2]}
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in hit)


def test_nothing_to_decontaminate(spark):
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(*none).count() == 0
    assert judged(spark, TEXTS, []) == contaminated(TEXTS, [])
    assert decontamination.longest(*none).count() == 0


def test_longest_matches(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs, items = [(k, text(40)) for k in range(30)], [(k, text(20)) for k in range(6)]
    want = {}
    for item, t in items:
        w = t.split()
        for s in range(len(w)):
            best = []
            for i, d in docs:
                x = d.split()
                for p in range(len(x)):
                    n = 0
                    while s + n < len(w) and p + n < len(x) and w[s + n] == x[p + n]:
                        n += 1
                    best.append((-n, i, p))
            n = -min(best)[0]
            if n >= 3:
                want[str(item), s] = (n, sum(b[0] == -n for b in best), *min(best)[1:])
    found = decontamination.longest(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), least=3, chunk_bytes=50)
    assert {(r.item_id, r.start): (r.length, r.n, r.doc_id, r.place) for r in found.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([1, 3, 9, 60]))
def test_suffix_array(symbols, depth):
    order = decontamination.suffix_array(np.array(symbols, np.int64), depth).tolist()
    assert sorted(order) == [k for k, x in enumerate(symbols) if x]
    end = lambda k: next((j for j in range(k, len(symbols)) if not symbols[j]), len(symbols))
    heads = [symbols[k : min(end(k), k + depth)] for k in order]
    assert heads == sorted(heads)


# 12


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def variants(counts, ratio=2):
    out, form = [], {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
        out.append((w, n, len(others)))
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, k, counts.get(form[w])) for w, n, k in out)


def solved(spark, counts):
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect())


def test_random_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abÀé") for _ in range(rng.randint(5, 8))) for _ in range(400)}
    counts = {w: rng.choice([3, 4, 6, 9, 18, 40, 80, 200]) for w in words}
    assert solved(spark, counts) == variants(counts)


def test_long_words_and_runs_of_one_letter(spark):
    base = "xyz" * 40
    words = ["a" * 5, "a" * 6, "a" * 7, "b" + "a" * 5, "a" * 63, "a" * 64, "a" * 65, "a" * 66, base, base[:50] + "q" + base[51:], base[:50] + base[51:], base + "q", "q" + base]
    counts = {w: 3 * 2**k for k, w in enumerate(words)}
    assert solved(spark, counts) == variants(counts)
    counts = dict.fromkeys(words, 7)
    assert solved(spark, counts) == variants(counts)


def test_equal_hashes_of_unlike_strings(monkeypatch):
    import pyarrow as pa

    words = ["abcde", "abcdf", "zzzzz", "abcd"]
    rows = [(0, k, p, w) for k, w in enumerate(words) for p in range(-1, len(w))]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(["key", "id", "place", "word"])}, schema=pa.schema([("key", pa.int64()), ("id", pa.int64()), ("place", pa.int32()), ("word", pa.string())]))
    got = {i: (n, b) for batch in spelling._judge(table) for i, n, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)}
    assert got == {0: (2, 1), 1: (2, 0), 3: (2, 0)}


def counted_by_hand(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_counts(spark, sf_dir):
    rng = random.Random(4)
    odd = [None, "", "Ünïcödé×÷ ÿÿÿÿÿ ĀĀĀĀĀ 日本 abcde", "x" * 300 + " " + "é" * 200, "ABCDE abcde aBcDe", "a1b2" * 9, "- " * 5]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:80]
    docs += [(k, t) for k, t in enumerate(odd)] * 3 + [(None, "abcde nullid nullid nullid")] * 2
    docs += [(k, "".join(rng.choice("abé X") for _ in range(400))) for k in range(40)]
    found = {r.word: r.n for r in spelling.counted(docs_of(spark, docs)).collect()}
    assert found == counted_by_hand(docs)


def test_no_words(spark):
    none = spelling.variants(spelling.counted(spark.createDataFrame([], DOCS)))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.count() == 0


# 13


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.BYTE_BPE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(Path(alignment.BYTE_BPE).read_bytes(), Path(alignment.PIECE_BPE).read_bytes())


def by_offsets(tokenizers, aligner, text):
    """Groups from the byte offsets of both libraries' tokens."""
    if not text:
        return []
    a, b = tokenizers[0].encode(" " + text, add_special_tokens=False).ids, tokenizers[1].encode(text)
    sides = [[aligner.a.bytes[k] for k in a], [aligner.b.bytes[k] for k in b]]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def aligned(tokenizers, aligner, docs):
    each = [(i, by_offsets(tokenizers, aligner, t)) for i, t in docs]
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for _, groups in each]
    count = Counter(p for x in links for p in set(x))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (i, groups), own in zip(each, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "   ", "<|endoftext|> a <s></s> <unk>", "▁ mark", "x ▁", "  two  spaces ", "\n\n a\tb \r\n  c   ", "日本語テキスト 🎉🎉👩‍👩‍👧 é é ﬁ", "trail ", "don't I'LL we've", "x" * 3000,
    "  nbsp  em", "\x00\x01 ctl", "a" * 50 + " " * 700 + "b", "é" * 400, "हिन्दी " * 30, "a b \u0085c", "end\n", "a \x1c b",
]


def test_alignment(spark, sf_dir, tokenizers, aligner, monkeypatch):
    rng = random.Random(3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:120]
    docs += list(enumerate(ODD)) + [(None, "a row"), (None, "a row"), (7, "word " * 40_000)]
    docs += [(k, "".join(rng.choice("abc  é\n\t▁<>s|日🎉' ́") for _ in range(rng.randint(1, 60)))) for k in range(200)]
    monkeypatch.setattr(alignment, "SHELF", 2)
    found = alignment.align(docs_of(spark, docs).repartition(7)).collect()
    assert sorted(map(tuple, found), key=str) == aligned(tokenizers, aligner, docs)


def test_large_groups_are_counted_by_distinct_ids(aligner, monkeypatch):
    texts = [t for t in ODD if t] + ["ab" * 50 + " cd"]
    plain = aligner.align(texts)
    monkeypatch.setattr(alignment, "WRITTEN_OUT", 1)
    aligner.forget()
    other = aligner.align(texts)
    aligner.forget()
    for n in ("stats", "first", "pairs", "times"):
        assert (getattr(plain, n) == getattr(other, n)).all()


def test_transducer_by_hand():
    machine = alignment.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"abd", b"d"])
    assert machine.groups([0, 1, 3], [0, 1, 4]) == ([2, 3], [2, 3])
    assert machine.groups([2, 3], [2]) == ([2], [1])
    assert machine.groups([0, 3], [3]) == ([2], [1])
    assert machine.groups([0, 1], [3]) is None and machine.groups([0], [0]) is None and machine.groups([], [0]) is None and machine.groups([], []) == ([], [])
    assert {s.rest for s in machine.states.values()} >= {b"", b"ab", b"c", b"abc"}


def test_no_documents_to_align(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0


def test_queries_have_their_columns(spark, sf_dir):
    assert queries.op13_tokenizer_alignment(spark, sf_dir).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
