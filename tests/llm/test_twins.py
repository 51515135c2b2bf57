"""Operators and the pipeline's stages against plain twins: one row, one word, one transition at a time."""

import hashlib
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import language_id, near_duplicates, quality, queries, secrets, sentencepiece_fst
from test_brute_force import base_spans, markov_spans, near_components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


# 7


def gram_buckets(text):
    """The hashed 1-, 2- and 3-grams within words, a blank at an edge at most."""
    letters = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    padded = [0, *letters, 0]
    out = []
    for n in (1, 2, 3):
        for at in range(len(padded) - n + 1):
            gram = padded[at : at + n]
            if 0 in gram[1:-1] or (gram[0] == 0 and gram[-1] == 0):
                continue
            value = n * 0x9E3779B1 & 0xFFFFFFFF
            for factor, point in zip((2654435761, 2246822519, 3266489917), gram, strict=False):
                value = (value ^ point) * factor & 0xFFFFFFFF
                value ^= value >> 15
            out.append((value * 2654435761 & 0xFFFFFFFF) >> 17)
    return out


def test_language_equals_plain_bayes(spark, rows):
    learned = [r for r in rows if r.doc_id % 2 and r.lang is not None]
    model = language_id.train(spark.createDataFrame(learned, "doc_id long, text string, lang string, source string, n_chars long"))
    counts, docs = {}, {}
    for r in learned:
        docs[r.lang] = docs.get(r.lang, 0) + 1
        own = counts.setdefault(r.lang, {})
        for b in gram_buckets(r.text or ""):
            own[b] = own.get(b, 0) + 1
    assert model.languages == sorted(counts)
    total = {x: sum(own.values()) + language_id.BUCKETS for x, own in counts.items()}
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in rows}
    for r in language_id.predict(frame, model).collect():
        found = gram_buckets(texts[r.doc_id] or "")
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        log = {x: math.log(docs[x] / len(learned)) + sum(math.log((own.get(b, 0) + 1) / total[x]) for b in found) for x, own in counts.items()}
        best = max(sorted(log), key=log.get)
        soft = [math.exp((v - log[best]) / math.sqrt(len(found))) for v in log.values()]
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(soft), rel=1e-6)


# 9


def byte_kind(x):
    c = chr(x)
    if x >= 128:
        return 3
    for kind, of in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", ".,;:'-?()\"", "", "!", "|")):
        if c in of:
            return kind
    return 5


def plain_passages(text):
    """The measures of each passage, word by word."""
    data = text.encode()
    found = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    out = []
    for at in range(0, max(1, len(found)), 64):
        part = found[at : at + 64]
        x = np.zeros(quality.WIDTH)
        if part:
            words = [w for _, w in part]
            joined, n = b"".join(words), len(words)
            sizes = [len(w) for w in words]
            for b in joined:
                x[byte_kind(b)] += 1 / len(joined)
            mean = sum(sizes) / n
            last = [byte_kind(w[-1]) for w in words]
            x[8:18] = [
                math.log1p(n), mean, math.sqrt(max(0, sum(s * s for s in sizes) / n - mean**2)), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
                len(set(words)) / n, sum(byte_kind(w[0]) == 1 for w in words) / n, sum(k == 4 for k in last) / n, sum(k in (5, 6) for k in last) / n,
                sum(place == 0 or data[place - 1] == 10 for place, _ in part) / n, sum(s == 1 for s in sizes) / n,
            ]
            for place, w in part:
                for k, b in enumerate(w):
                    after = data[place + k + 1] if place + k + 1 < len(data) else 10
                    x[18 + ((b * 31 + after) * 2654435761 % 2**32 >> 27)] += 1 / len(joined)
            x[18:] = np.sqrt(x[18:])
        out.append(x)
    return np.array(out)


def plain_score(w, x):
    """Gated attention, passage by passage."""
    h = [np.tanh(p @ w["E"] + w["e"]) for p in x]
    s = [float(w["w"] @ (np.tanh(p @ w["V"]) / (1 + np.exp(-(p @ w["U"]))))) for p in h]
    a = [math.exp(v - max(s)) for v in s]
    z = sum(v / sum(a) * p for v, p in zip(a, h, strict=True))
    return 1 / (1 + math.exp(-float(z @ w["c"] + w["b"][0])))


def test_quality_equals_passage_by_passage(spark, rows, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x = np.clip((plain_passages(r.text or "") - model.mean) / model.scale, -6, 6)
        score = plain_score(model.weights, x)
        assert got[r.doc_id][0] == pytest.approx(score, abs=1e-4), r.doc_id
        assert got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.3)


def test_quality_fits_within_its_passages(spark, monkeypatch):
    """Documents are taken in the order of a hash while their passages fit; length alone keeps none out."""
    seen = []
    monkeypatch.setattr(quality, "MOST_PASSAGES", 20)
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.extend(len(b) for b in bags))
    docs = spark.createDataFrame([(k, "word " * (64 * (k % 5 + 1))) for k in range(40)] + [(99, "word " * 64 * 21)], "doc_id long, text string")
    quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"))
    assert 15 < sum(seen) <= 20 and max(seen) > 1


# the pipeline


@pytest.mark.parametrize("most", [0, 10**6])
def test_one_of_each_equals_brute_force(spark, monkeypatch, rows, most):
    monkeypatch.setattr(near_duplicates, "MOST_KEYS", most)
    monkeypatch.setattr(near_duplicates, "MOST_HASHES", most)
    texts = {r.doc_id: r.text for r in rows}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows + rows[:40], schema)  # some rows twice
    kept = near_duplicates.one_of_each(frame)
    assert kept.columns == frame.columns
    no_words = [r.doc_id for r in rows + rows[:40] if not WORD.search(r.text or "")]
    expected = [i for i, (n, _, stays) in near_components(texts, 5).items() if n and stays]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected + no_words)


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    by_id = lambda frame: {r.doc_id: r for r in frame.collect()}
    # quality classifier
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    before, kept = by_id(docs), stages["quality classifier"](spark, docs, sf_dir).persist()
    score = {i: plain_score(model.weights, np.clip((plain_passages(r.text or "") - model.mean) / model.scale, -6, 6)) for i, r in before.items()}
    assert by_id(kept) == {i: r for i, r in before.items() if score[i] >= 0.3}
    # MinHash near-dedup, five words
    before, alone = by_id(kept), stages["minhash near-dedup"](spark, kept, sf_dir).persist()
    found = near_components({i: r.text for i, r in before.items()}, 5)
    assert by_id(alone) == {i: r for i, r in before.items() if found[i][2]}
    # secret scans
    ratios = secrets.train(secrets.labelled_samples(spark))
    before, clean = by_id(alone), stages["secret scans"](spark, alone, sf_dir).persist()
    after, changed = by_id(clean), 0
    assert after.keys() == before.keys()
    for i, r in before.items():
        text, end, out = r.text or "", 0, []
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in base_spans(text) + markov_spans(text, ratios))
        for a, b in places:
            if a >= end:
                out += [text[end:a], "[SECRET]"]
            end = max(end, b)
        expected = "".join(out) + text[end:] if places else r.text
        changed += expected != r.text
        assert after[i].text == expected and after[i].n_chars == (None if expected is None else len(expected))
    assert changed
    # mixing: by the SQL that checks the mix of whole tables
    import duckdb

    con = duckdb.connect()
    con.register("stage", clean.toPandas())
    con.sql("create view documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from stage")
    copies = {r[0]: (r[1], r[2]) for r in con.sql("select doc_id, size, taken from (" + queries.OP6_SQL + ")").fetchall()}
    mixed = stages["source mixing"](spark, clean, sf_dir).persist()
    times = {}
    for r in mixed.collect():
        assert r == after[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(i, 0) * size == taken for i, (size, taken) in copies.items() if size)
    # SentencePiece
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    out = stages["sentencepiece encoding"](spark, mixed, sf_dir).collect()
    assert len(out) == sum(times.values())
    for r in out:
        text = after[r.doc_id].text or ""
        assert list(r.ids) == library.encode(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.replace("\u2581", " ").encode()).hexdigest()
