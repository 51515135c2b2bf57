"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import audio, language_id, mixing, near_duplicates, neighbours, quality, secrets, sentencepiece_fst, substrings, url_filter

#: Columns with names that operators use themselves.
EXTRA = "block long, key string, num long, node string, _row string, size long, ids string, `a b` string, cell int, group string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = "wort " * 40_000


def rows():
    extra = (1, "k", 2, "n", "r", 3, "i", "x", 4, "g")
    base = [
        (1, "the cat sat on the mat and then it went home again", "en", "s1"),
        (1, "the cat sat on the mat and then it went home again", "en", "s1"),
        (2, "", "en", "s1"),
        (3, None, None, None),
        (None, "a row without an id", None, "s2"),
        (None, "a row without an id", None, "s2"),
        (4, "   \n\t ", "de", "s2"),
        (5, LONG, "de", None),
        (6, "one", None, "s1"),
        (7, "é 你好 ▁ \U0001f600", "xx", "s3"),
    ]
    return [(*b, len(b[1] or ""), *extra) for b in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int, text string"


def test_encode(spark, docs, none):
    out = sentencepiece_fst.encode(docs).collect()
    assert len(out) == 10
    by = {(r.doc_id, r.decoded) for r in out}
    assert (3, None) in by and (2, "") in by and (5, LONG) in by and (7, "é 你好   \U0001f600") in by
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0, None}
    assert sentencepiece_fst.encode(none).count() == 0
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, decode=False)).collect()
    assert {(r.doc_id, r.text) for r in back} == by


def test_substrings(docs, none):
    out = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(docs, width=3).collect()}
    assert out == {(1, 12, 0), (2, 0, 0), (3, 0, 0), (None, 5, 0), (4, 0, 0), (5, 40_000, 0), (6, 1, 0), (7, 4, 0)}
    assert substrings.dedup(none).count() == 0


def test_null_ids_come_last(spark):
    both = spark.createDataFrame([(None, "a b c d"), (9, "x a b c d")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed, r.kept) for r in substrings.dedup(both, width=3).collect()} == {(None, 4, ""), (9, 0, "x a b c d")}


def test_secrets(spark, docs, none):
    out = secrets.scan(docs).collect()
    assert len(out) == 10 and all(r.spans == "" for r in out)
    assert secrets.scan(none).count() == 0
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))


def test_near_duplicates(docs, none):
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.classes(docs).collect()}
    assert out == {(1, 8, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True)}
    assert near_duplicates.classes(none).count() == 0
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert near_duplicates.one_of_each(none).count() == 0


def test_urls(spark):
    urls = ["http://A.example.NET/en/x?q", "https://net", None, "no scheme", "http://x.org/fr", "http://x.org/fr/a#b", "", "://net/"]
    pages = spark.createDataFrame([(k, u, "e") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "block")]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert out[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") == out[8]
    assert out[1] == ("net", "", None, "allow") and out[2] == ("", "", None, "allow") == out[3] == out[6]
    assert out[4] == ("x.org", "/fr", None, "allow") and out[5] == ("x.org", "/fr/a", "org/fr/", "block") and out[7] == ("net", "/", "net/", "block")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs).collect()
    assert len(out) == 10 and all(0 <= r.taken <= 2 * r.size for r in out)
    assert mixing.mix(none).count() == 0
    repeated = mixing.mixed_rows(docs)
    assert repeated.columns == docs.columns
    assert sorted(map(str, repeated.collect())) == sorted(map(str, mixing.mixed_rows(docs).collect()))
    assert mixing.mixed_rows(none).count() == 0


def test_language(docs, none):
    model = language_id.train(docs)
    out = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (5, "de")} <= out
    assert language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(none)).collect()} == {"und"}


def test_audio(docs, none):
    stored = audio.store(docs)
    out = {r.doc_id: r for r in stored.collect()}
    assert out[2].n_bytes == out[3].n_bytes == 0 and out[2].media == out[3].media
    assert out[5].n_bytes == len(LONG)
    found = audio.measure(stored).collect()
    assert len(found) == 10 and {r.payload_bytes for r in found if r.doc_id in (2, 3)} == {64}
    assert audio.measure(audio.store(none)).count() == 0


def test_quality_fits_on_a_repeated_id_once(spark, monkeypatch):
    rows = [(1, "good words here")] * 40 + [(1, "a least text")] + [(k, f"text number {k}") for k in range(2, 7)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append((len(bags), y.sum())))
    quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=6)
    assert seen == [(6, 3.0)]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0, "t"), (5, 0, 0, "t"), (6, 0, 0, "t"), (7, None, None, "t"), (None, 1, 0, "t")], LABELS)
    model = quality.train(docs, labels)
    out = quality.predict(docs, model).collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.score for r in quality.predict(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.predict(none, model).count() == 0
    assert quality.scored_rows(docs, model).columns == docs.columns


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 3), 1.0]) for k in range(1, 6)] + [(4, [1.0, 1.0])]
    bad = [(6, None), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (None, [1.0, 1.0]), (11, [1.0])]
    vectors = spark.createDataFrame([(*v, "e") for v in good + bad], "vec_id long, embedding array<double>, cell string")
    out = neighbours.search(vectors, lambda i: i % 2 == 0, k=3).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out if r.query_id == 2}
    assert found == {(2, 1): (5, 0.0), (2, 2): (1, 1.0), (2, 3): (4, 1.0)}
    assert {r.query_id for r in out} == {2, 4}
    assert neighbours.search(vectors.limit(0), lambda i: i > 0).count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stages(at, spark, docs, none, sf_dir):
    import corpus_pipeline

    stage = corpus_pipeline.STAGES[at][1]
    out = stage(spark, docs, sf_dir)
    if at < 4:
        assert out.columns == docs.columns
    out.collect()
    assert stage(spark, none, sf_dir).count() == 0


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert kept and sum(labels.get(d) == 0 for d in kept) <= 2
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_url_ties_repeats_and_long_urls(spark):
    """Of an allow and a block rule for one place the block counts; repeated rows and urls of any length are judged like others."""
    rules = [("a.org", "/x/", "allow"), ("a.org", "/x/", "block"), ("org", "/", "allow")]
    urls = [(1, "http://a.org/x/y"), (1, "http://a.org/x/y"), (2, "http://" + "b." * 2000 + "org/" + "p/" * 5000), (3, "http://a.org/" + "x" * 100_000)]
    out = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in out) == [(1, "a.org/x/", "block"), (1, "a.org/x/", "block"), (2, "org/", "allow"), (3, "org/", "allow")]
