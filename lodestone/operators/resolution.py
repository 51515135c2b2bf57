"""Which function a call means: tiers of evidence, then overloads by owner, arity and types.

Calls that ask the same question are answered once: a call is looked up by its shape (names, types, count of arguments), and functions with one
signature are one candidate with a count, so a hot name costs its distinct shapes and signatures, not its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.joins import tiered

#: Spellings of one type.  Fixed values: the boxed and Kotlin names of the primitive types of the JVM.
SAME_TYPE = {
    "Boolean": "boolean", "Byte": "byte", "Character": "char", "Char": "char", "Double": "double", "Float": "float", "Int": "int",
    "Integer": "int", "Long": "long", "Short": "short", "String": "string", "Nothing": "null",
}
#: The primitive types in the order in which they widen; a char widens like a short but not to it.
WIDENING = ["byte", "short", "int", "long", "float", "double"]
PRIMITIVES = [*WIDENING, "char", "boolean"]
# Scores of a type and of the number of arguments.
EXACT, CONVERTED = 4, 1
ALL_ARGUMENTS, SOME_ARGUMENTS = 4, 2


def resolve(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` with ``tier`` and ``fn_id``: the first tier that knows the call decides, and several targets in it are none.

    The tiers: ``import`` (what the file binds the call's text to), ``qualified`` (receiver and name in the file), ``local`` (the name in the file),
    ``global`` (the name anywhere), ``suffix`` (the end of a qualified name).  A call whose first word the file imports, but to nothing that is
    known, has no target: its tier is ``external``.  Each distinct (file, receiver, name) is looked up once and joined back to its calls.

    ``calls``: ``file_path``, ``receiver`` (null: none), ``callee``; ``functions``: ``fn_id``, ``file_path``, ``name``, ``qualified_name``;
    ``imports``: ``file_path``, ``binding``, ``fn_id`` (null: outside), where ``binding`` is the text as called, dots and all."""
    shape = ["file_path", "receiver", "callee"]
    whole = F.concat_ws(".", "receiver", "callee")
    asked = calls.select(*shape).distinct().withColumns({"_full": whole, "_owned": F.when(F.col("receiver").isNotNull(), whole), "_word": F.split_part(whole, F.lit("."), F.lit(1))})
    bound = imports.filter("fn_id is not null").select("file_path", F.col("binding").alias("_full"), "fn_id")
    parts = F.split("qualified_name", r"\.")
    owner = functions.select("file_path", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".").alias("_owned"), "fn_id")
    names = functions.select("file_path", F.col("name").alias("callee"), "fn_id")
    ends = functions.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("callee"), "fn_id")
    tiers = [
        ("import", bound, ["file_path", "_full"]), ("qualified", owner, ["file_path", "_owned"]), ("local", names, ["file_path", "callee"]),
        ("global", names, ["callee"]), ("suffix", ends, ["callee"]),
    ]
    found = tiered(asked, tiers, "fn_id")
    words = imports.select("file_path", F.split_part("binding", F.lit("."), F.lit(1)).alias("_word")).distinct().withColumn("_declared", F.lit(True))
    outside = F.coalesce("_declared", F.lit(False)) & ~F.coalesce(F.col("tier") == "import", F.lit(False))
    answers = found.join(words, ["file_path", "_word"], "left").select(
        *(F.col(c).alias(f"_{c}") for c in shape), F.when(outside, "external").otherwise(F.col("tier")).alias("tier"), F.when(~outside, F.col("fn_id")).alias("fn_id")
    )
    return calls.join(answers, [calls[c].eqNullSafe(answers[f"_{c}"]) for c in shape], "left").select(calls["*"], "tier", "fn_id")


def bare_type(name: Column) -> Column:
    """A type without annotations, generics, package, array, vararg and null marks, in one spelling; null stays null."""
    plain = F.regexp_replace(F.regexp_replace(name, r"@[\w.]+(\([^)]*\))?\s*", ""), r"<.*>|\s|\.\.\.|\[\]|\?$", "")
    last = F.substring_index(plain, ".", -1)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SAME_TYPE.items() for x in pair)), last), last)


def type_score(actual: Column, expected: Column) -> Column:
    """How well an argument's type fits a parameter's: 4 the same, 1 converted, 0 where either is unknown, null where it can't be passed.

    Both are bare types."""
    order = lambda t: F.array_position(F.array(*map(F.lit, WIDENING)), F.when(t == "char", "short").otherwise(t))
    widens = (order(actual) > 0) & (order(actual) < order(expected)) & ~expected.isin("char")
    unknown = F.coalesce(actual, F.lit("")).eqNullSafe("") | F.coalesce(expected, F.lit("")).isin("", "*")
    boxed = (actual == "null") & ~expected.isin(*PRIMITIVES)
    return F.when(unknown, 0).when(actual == expected, EXACT).when(boxed | ((actual != "null") & widens), CONVERTED)


def overload_score(arguments: Column, parameters: Column, optional: Column, variadic: Column) -> Column:
    """The score of one candidate, null where the arguments don't fit.

    ``arguments``, ``parameters``: arrays of bare types; ``optional``: which parameters have a default.  The right number of arguments scores 4, another
    one that fits 2, and each argument adds its ``type_score``; further arguments of a variadic function are held against its last parameter."""
    given, most = F.size(arguments), F.size(parameters)
    least = F.size(F.filter(F.transform(parameters, lambda _, k: F.coalesce(F.get(optional, k), F.lit(False)) | (variadic & (k == most - 1))), lambda x: ~x))
    each = F.transform(arguments, lambda a, k: F.when(F.coalesce(a, F.lit("")) == "", 0).when(most > 0, type_score(a, F.get(parameters, F.least(k, most - 1)))))
    total = F.aggregate(each, F.when(given == most, ALL_ARGUMENTS).otherwise(SOME_ARGUMENTS), lambda acc, x: acc + x)
    return F.when((given >= least) & (variadic | (given <= most)), total)


def overloads(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``calls`` with ``fn_id`` (the one best candidate, null if none or several are best), ``candidates`` (their number) and ``score``.

    Candidates have the call's name and repository.  Of these, the ones of the receiver's class count if there are any; without a known receiver,
    those of the caller's class if there are any.  ``calls``: ``name``, ``repository_id``, ``receiver_type``, ``caller_class``, ``arguments`` (types);
    ``functions``: ``fn_id``, ``name``, ``repository_id``, ``class_name``, ``parameters`` (types), ``optional``, ``variadic``."""
    shape = ["name", "repository_id", "receiver_type", "caller_class", "arguments"]
    asked = calls.select(*shape).distinct()
    asked = asked.select("*", F.transform("arguments", bare_type).alias("_given"), F.when(F.col("receiver_type").isNotNull(), bare_type(F.col("receiver_type"))).otherwise(F.col("caller_class")).alias("_owner"))
    signature = ["name", "repository_id", "_class", "_bare", "optional", "variadic"]
    typed = functions.select("fn_id", "name", "repository_id", F.col("class_name").alias("_class"), F.transform("parameters", bare_type).alias("_bare"), "optional", "variadic")
    known = typed.groupBy(*signature).agg(F.count_distinct("fn_id").alias("_n"), F.min("fn_id").alias("_one"))
    plain = F.when(F.col("receiver_type").isNotNull(), bare_type(F.col("_class"))).otherwise(F.col("_class"))
    met = asked.join(known, ["name", "repository_id"]).withColumn("_own", F.coalesce(plain == F.col("_owner"), F.lit(False)))
    scored = met.withColumn("_score", overload_score(F.col("_given"), F.col("_bare"), F.col("optional"), F.col("variadic")))
    # per narrowing and score, so that the narrower set decides once its members are counted
    by_score = scored.groupBy(*shape, "_own", "_score").agg(F.sum("_n").alias("n"), F.min("_one").alias("one"))
    best = by_score.groupBy(*shape, "_own").agg(F.sum("n").alias("of"), F.max(F.when(F.col("_score").isNotNull(), F.struct("_score", "n", "one"))).alias("b"))
    pick = best.groupBy(*shape).agg(F.max(F.struct("_own", "of", "b")).alias("p"))
    answers = pick.select(*(F.col(c).alias(f"_{c}") for c in shape), F.when(F.col("p.b.n") == 1, F.col("p.b.one")).alias("fn_id"), F.col("p.of").alias("candidates"), F.col("p.b._score").alias("score"))
    return calls.join(answers, [calls[c].eqNullSafe(answers[f"_{c}"]) for c in shape], "left").select(calls["*"], "fn_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), "score")


def overrides(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """``method``, ``overridden``: a method and the one of the same descriptor in a direct parent, where that is unique; constructors and static ones never.

    ``methods``: ``method``, ``type``, ``descriptor``, ``is_static``; ``parents``: ``type``, ``parent``."""
    able = methods.filter(~F.col("is_static") & ~F.startswith("descriptor", F.lit("<init>")))
    above = able.select(F.col("type").alias("parent"), "descriptor", F.col("method").alias("overridden"))
    found = able.join(parents.distinct(), "type").join(above, ["parent", "descriptor"]).groupBy("method")
    return found.agg(F.count_distinct("overridden").alias("n"), F.min("overridden").alias("overridden")).filter("n = 1").select("method", "overridden")
