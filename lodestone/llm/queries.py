"""The training-data operators' queries: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, audio, decontamination, language_id, mixing, near_duplicates, neighbours, quality, secrets, sentencepiece_fst, spelling, substrings, url_filter
from lodestone.llm.common import read, written

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(rverdict, length(rhost) * 1000 + length(rpath)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM hosts
"""


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two media tables are written and read back: the mu-law files, then their samples resampled to 16,000 Hz, packed without loss; both compressed a level that keeps the disk in bounds."""
    media = written(spark, audio.store(read(spark, sf_dir, "documents")), "audio-media", level=9)
    return audio.measure_pcm(written(spark, audio.measure(media, pack=True), "audio-pcm", level=9))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies", "group")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C")) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS full_at FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM filled),
goals AS (
  SELECT source, source_size,
         CASE WHEN level >= full_at THEN most
              ELSE max(CASE WHEN level < full_at THEN level END) OVER () * weight END AS target
  FROM levels),
steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216)::BIGINT ELSE 0 END AS step,
         ('0x' || substr(md5(coalesce('s' || source, 'none')), 1, 6))::BIGINT AS shift
  FROM goals),
ranked AS (
  SELECT doc_id, source, size,
         row_number() OVER (PARTITION BY source ORDER BY
           length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)),
           coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 0), doc_id, size) AS rank
  FROM sized)
SELECT doc_id, size, source_size, target,
       size * (((rank * step + shift) >> 24) - (((rank - 1) * step + shift) >> 24)) AS taken
FROM ranked JOIN steps ON ranked.source IS NOT DISTINCT FROM steps.source
"""


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_fst.encode(read(spark, sf_dir, "documents"))
    return found.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(read(spark, sf_dir, "documents"), keep_text=False)
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans", "factors")


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words),
phrases AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase FROM starts),
firsts AS (SELECT phrase, min(doc_id) AS least FROM phrases GROUP BY phrase),
known AS (
  SELECT doc_id, i FROM phrases JOIN firsts USING (phrase) WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM known),
gone AS (SELECT doc_id, list(i) AS off FROM covered GROUP BY doc_id),
runs AS (
  SELECT doc_id, count(*)::BIGINT AS n_spans
  FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM covered) WHERE gap IS NULL OR gap > 1
  GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, list_filter(w, lambda x, i: NOT list_contains(coalesce(off, []), i)) AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT kept.doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM kept LEFT JOIN runs ON kept.doc_id = runs.doc_id
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.classes(read(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, b FROM reached JOIN links ON a = other),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM components LEFT JOIN sizes USING (doc_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model).withColumn("held_out", held_out)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs, labels.filter(~held_out))
    return quality.predict(docs, model).withColumn("held_out", held_out)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS s
  FROM items WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS i, w FROM words, widths WHERE len(w) >= width),
found AS (
  SELECT doc_id, item_id, i, width FROM (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS s FROM places) JOIN windows USING (width, s)),
hits AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(read(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS before, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY 1, 2),
bytes AS (
  SELECT r, times, flatten(list_transform(string_split(before || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64::BIGINT] END)) AS b
  FROM runs),
summed AS (
  SELECT r, times, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc),
damaged AS (
  SELECT times, CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word FROM summed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON s = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON s = words.word),
best AS (
  SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
found AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 2 * words.n THEN other END AS form, CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word AND k = 1),
way(word, place, steps) AS (
  SELECT word, word, 0 FROM found UNION ALL SELECT way.word, form, steps + 1 FROM way JOIN found ON place = found.word WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(place, steps) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)
"""


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_secret_scan": op3_secret_scan,
        "op4_near_dedup": op4_near_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_source_mix": op6_source_mix,
        "op7_language_id": op7_language_id,
        "op9_quality": op9_quality,
        "op10_neighbours": op10_neighbours,
        "op8_telephony_audio": op8_telephony_audio,
        "op11_decontamination": op11_decontamination,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op4_near_dedup": OP4_SQL, "op5_url_filter": OP5_SQL, "op6_source_mix": OP6_SQL, "op11_decontamination": OP11_SQL, "op12_spelling_variants": OP12_SQL}
