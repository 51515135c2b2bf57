"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base spans come from three patterns.  The method adds spans: a token (a run of key characters) is scored by two
first-order character Markov models, one trained on random strings and one on ordinary identifiers; where the
log-likelihood ratio of its transitions exceeds ``PRIOR`` and ``threshold`` for each of them, the token is a secret of kind ``markov``.
Both models come from labelled samples (``train``): transition counts with add-one smoothing over the alphabet.
The sample set is bounded and made from rules (``labelled_samples``), so the model never depends on the corpus.

Only DataFrame functions run: positions follow from the lengths of the pieces between matches, as
``split`` and ``regexp_extract_all`` see the same leftmost non-overlapping matches.  Offsets count code points,
ends are exclusive.

Defined results: a null or empty text has no spans (counts 0, empty strings; the text stays as it is); very
long texts are scanned whole; repeated rows give repeated results; an empty table gives an empty table; columns
of the input other than the id and the text are carried only by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, by kind.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
LEAST_ASSIGNED = 12

#: Characters of a token that the models know, in the order of their index.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
LEAST_TOKEN = 16
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % LEAST_TOKEN
#: A token counts as random where its log-likelihood ratio exceeds ``PRIOR`` and ``THRESHOLD`` for each transition (nats), so a short token
#: has to be more conspicuous than a long one.  Chosen on labelled tokens of another origin than the samples: the 2,636 names of 16 characters or more in
#: Python's standard library, none of which fires, and keys of nine alphabets and five lengths.
PRIOR, THRESHOLD = 7.5, 0.5
#: Bound of the sample set: so many strings of either label.
SAMPLES = 4000

# Words that identifiers are made of.
IDENTIFIER_WORDS = (
    "account action active address alpha amount array async author base batch block body buffer build button cache "
    "call channel check child class client close code column command common config connect content context control "
    "count create current data database date debug default delete detail device document domain download element "
    "email enable encode engine entry error event example export factory field file filter first folder format "
    "function global group handler header height hidden host image import index info input instance item job key "
    "label language last layout length level library limit line link list load local location login manager map "
    "master match member memory menu message method model module monitor name network node number object offset "
    "option order output package page panel parent parse path pattern payment percent plugin point policy position "
    "prefix price process product profile project property provider query queue random range record region register "
    "release remote report request resource response result role root route rule sample schema scope screen script "
    "search section select sender sequence server service session setting shape shared simple source stack start "
    "state static status storage stream string style submit summary support switch symbol system table target task "
    "template test text thread time title total track transfer type update upload user utility value vector version "
    "view visible volume warning width window worker wrapper"
).split()

# Words of other languages that ordinary tokens are made of.
NATURAL_WORDS = (
    "abend arbeit bild brief buch deutsch einfach erde fenster freund garten gegen geschichte gesellschaft haus heute himmel jahr kirche "
    "leben licht mensch morgen nacht ordnung recht schiff schnell schule sprache stadt strasse stunde tisch vergangenheit verkehr wasser "
    "welt winter wirtschaft wissenschaft zeitung zwischen ami arbre beaucoup bonjour chambre chemin cheval chose coeur demain eau enfant femme feuille "
    "fleur garçon gouvernement heure homme jour journal lumière maison matin monde montagne oiseau parole petit peuple pierre quelque rivière "
    "semaine soleil temps travail vieux ville voiture agua amigo calle camino casa ciudad cuando dinero escuela espacio familia "
    "gobierno hermano historia hombre iglesia juego lugar mañana mesa mundo noche nombre palabra pequeño pueblo siempre tiempo trabajo ventana verano verdad"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``n`` random strings and ``n`` identifiers: ``token``, ``is_random``.

    Random ones are base64, base64 for urls, letters and digits, capitals and digits, hex in either case, and letters alone, of 16 to 64
    characters.  Identifiers are one to five words in the usual styles, some with a number behind."""
    salted = lambda salt: F.concat(F.lit(salt), F.col("id").cast("string"))
    pick = lambda salt, n: F.pmod(F.crc32(salted(salt)), F.lit(n)).cast("int")
    digest = F.unhex(F.concat(F.sha2(salted("r"), 512), F.sha2(salted("s"), 512)))
    # the pool of random characters that one row draws from
    pool, shape = F.regexp_replace(F.base64(digest), "[^A-Za-z0-9+/]", ""), pick("shape", 8)
    made = (
        F.when(shape <= 1, pool)
        .when(shape == 2, F.translate(pool, "+/", "-_"))
        .when(shape == 3, F.regexp_replace(pool, "[+/]", ""))
        .when(shape == 4, F.upper(F.regexp_replace(pool, "[+/]", "")))
        .when(shape == 5, F.lower(F.hex(digest)))
        .when(shape == 6, F.hex(digest))
        .otherwise(F.regexp_replace(pool, "[^A-Za-z]", ""))
    )
    random = spark.range(n).select(F.substring(made, F.lit(1), pick("length", 49) + 16).alias("token"), F.lit(True).alias("is_random"))
    words = F.array(*map(F.lit, IDENTIFIER_WORDS + NATURAL_WORDS))
    parts = F.slice(F.array(*(F.element_at(words, pick(f"w{k}", len(IDENTIFIER_WORDS + NATURAL_WORDS)) + 1) for k in range(5))), F.lit(1), pick("parts", 5) + 1)
    title = F.transform(parts, F.initcap)
    style = pick("style", 9)
    named = (
        F.when(style == 0, F.array_join(parts, "_"))
        .when(style == 1, F.array_join(parts, "-"))
        .when(style == 2, F.array_join(title, ""))
        .when(style == 3, F.concat(parts[0], F.array_join(F.slice(title, 2, 4), "")))
        .when(style == 4, F.array_join(parts, "/"))
        .when(style == 5, F.upper(F.array_join(parts, "_")))
        .when(style == 6, F.array_join(parts, ""))
        .when(style == 7, F.upper(F.array_join(parts, "")))
        .otherwise(F.array_join(title, "-"))
    )
    number = F.when(pick("numbered", 4) == 0, F.concat(F.lit("_"), pick("number", 3000).cast("string"))).otherwise("")
    return random.union(spark.range(n).select(F.concat(named, number).alias("token"), F.lit(False).alias("is_random")))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, row by row of the alphabet; bounded by its square.

    ``samples``: ``token``, ``is_random``.  Characters outside the alphabet end a transition."""
    k = len(ALPHABET)
    pairs = (
        samples.filter(F.length("token") > 1)
        .select(
            "is_random",
            F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substr(token, i, 2))")).alias("pair"),
        )
        .selectExpr(
            "is_random",
            f"instr('{ALPHABET}', substr(pair, 1, 1)) AS a",
            f"instr('{ALPHABET}', substr(pair, 2, 1)) AS b",
        )
    )
    counts = pairs.filter("a > 0 AND b > 0").groupBy("is_random", "a", "b").count().collect()
    seen = {(r["is_random"], r["a"], r["b"]): r["count"] for r in counts}
    table = []
    for a in range(1, k + 1):
        totals = [sum(seen.get((label, a, b), 0) for b in range(1, k + 1)) + k for label in (True, False)]
        for b in range(1, k + 1):
            p, q = ((seen.get((label, a, b), 0) + 1) / total for label, total in zip((True, False), totals, strict=True))
            table.append(math.log(p / q))
    return table


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, group: int, if_: str) -> Column:
    """``array<struct<s,e,g>>``: start, end and the wanted group of every leftmost non-overlapping match.

    Lengths are summed in chunks of 256 matches, then over the chunks, so that many matches in one text stay cheap."""
    kind = "array<struct<s:int,e:int,g:string>>"
    p = _quoted(pattern)
    # the whole match is extracted once
    wanted, more = (2, f", regexp_extract_all({text}, {p}, {group}))") if group else (1, ")")
    return F.expr(f"""
      CASE WHEN {if_} THEN
        element_at(transform(array(
            arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0){more}), z ->
          element_at(transform(array(transform(sequence(0, (size(z) - 2) div 256), c ->
            aggregate(slice(z, CAST(c AS int) * 256 + 1, least(256, size(z) - 1 - CAST(c AS int) * 256)),
              named_struct('n', 0, 'found', CAST(array() AS {kind})),
              (acc, x) -> named_struct(
                'n', acc.n + length(x.`0`) + length(x.`1`),
                'found', concat(acc.found, array(named_struct(
                  's', acc.n + length(x.`0`), 'e', acc.n + length(x.`0`) + length(x.`1`), 'g', x.`{wanted}`))))))), chunks ->
            flatten(zip_with(chunks,
              aggregate(chunks, named_struct('n', 0, 'found', CAST(array() AS array<int>)),
                (acc, c) -> named_struct('n', acc.n + c.n, 'found', concat(acc.found, array(acc.n)))).found,
              (c, o) -> transform(c.found, m -> named_struct('s', o + m.s, 'e', o + m.e, 'g', m.g))))), 1)), 1)
      ELSE CAST(array() AS {kind}) END""")


def _as_spans(matches: str, kind: str, where: str = "true") -> str:
    return (
        f"transform(filter({matches}, m -> {where}), "
        f"m -> named_struct('s', m.s, 'k', {KINDS.index(kind)}, 'e', m.e))"
    )


def _written_out(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, m -> concat(element_at(array({names}), m.k + 1), ':', m.s, ':', m.e)), ',')"


def find(
    docs: DataFrame,
    ratios: list[float] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row per document: the id, ``text``, ``base`` and ``every``, arrays of (start, kind's number, end) in order.

    ``ratios`` is what ``train`` returns; without it the models are trained here."""
    ratios = ratios if ratios is not None else train(labelled_samples(docs.sparkSession))
    k = len(ALPHABET)
    table = "array(" + ",".join(f"{x:.17g}D" for x in ratios) + ")"
    score = f"""
      element_at(transform(array(transform(split(m.g, ''), c -> instr('{ALPHABET}', c) - 1)), a ->
        aggregate(sequence(0, size(a) - 2), 0D, (t, i) -> t + get(ratios, get(a, i) * {k} + get(a, i + 1)))), 1)"""
    found = (
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
            *(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"),) * bool(carry),
        )
        .withColumn("assign", _matches("_text", ASSIGN, 1, f"_text RLIKE {_quoted(ASSIGN)}"))
        .withColumn("access", _matches("_text", ACCESS, 0, "contains(_text, 'AKIA')"))
        .withColumn("hex", _matches("_text", HEX, 0, f"_text RLIKE {_quoted(HEX)}"))
        .withColumn("token", _matches("_text", TOKEN, 0, f"_text RLIKE {_quoted(TOKEN)}"))
        .withColumn(
            "base",
            F.expr(
                f"""array_sort(concat({_as_spans("assign", "assign", f"length(m.g) >= {LEAST_ASSIGNED}")},
                {_as_spans("access", "access")}, {_as_spans("hex", "hex")}))"""
            ),
        )
        .withColumn("ratios", F.expr(table))
        .withColumn(
            "added",
            F.expr(
                _as_spans(
                    "token",
                    "markov",
                    f"NOT exists(base, b -> b.s < m.e AND b.e > m.s) AND {score} > {PRIOR:.17g}D + {threshold:.17g}D * (length(m.g) - 1)",
                )
            ),
        )
        .withColumn("every", F.expr("array_sort(concat(base, added))"))
    )
    return found.select("_id", "_text", "base", "every", *["_row"] * bool(carry))


def scan(docs: DataFrame, ratios: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``n_markov``, ``spans``."""
    count = lambda spans, kind: F.expr(f"CAST(size(filter({spans}, m -> m.k = {KINDS.index(kind)})) AS long)")
    return find(docs, ratios, id_col=id_col, text_col=text_col).select(
        F.col("_id").alias(id_col),
        count("base", "assign").alias("n_assign"),
        count("base", "access").alias("n_access"),
        count("base", "hex").alias("n_hex"),
        F.sha2(F.expr(_written_out("base")), 256).alias("base_sha256"),
        count("every", "markov").alias("n_markov"),
        F.expr(_written_out("every")).alias("spans"),
    )


def redact(
    docs: DataFrame,
    ratios: list[float] | None = None,
    mark: str = "[SECRET]",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; overlapping spans become one mark."""
    found = find(docs, ratios, id_col=id_col, text_col=text_col, carry=tuple(docs.columns))
    clean = F.expr(f"""
      CASE WHEN size(every) = 0 THEN _row.`{text_col}` ELSE
        element_at(transform(array(
          aggregate(every, named_struct('at', 0, 'found', CAST(array() AS array<string>)), (acc, m) -> named_struct(
            'at', greatest(acc.at, m.e),
            'found', CASE WHEN m.s >= acc.at THEN concat(acc.found, array(substr(_text, acc.at + 1, m.s - acc.at), '{mark}'))
                   ELSE acc.found END))), acc -> concat(array_join(acc.found, ''), substr(_text, acc.at + 1))), 1)
      END""")
    return found.select(*(clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
