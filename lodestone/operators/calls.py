"""Rules over calls: what is called, on what, with which arguments and options, in which function.

``calls`` have ``file_path``, ``language``, ``line``, ``callee``, ``receiver`` (null: none), ``arguments`` (their texts), and, where a rule asks for them,
``facts`` (what ``argument_facts`` gives; null: unknown) and ``context`` (the text around the call).  A set of rules is one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.findings import first_of

STATES = ("true", "false", "missing", "unknown")
FACT = "struct<kind:string,name:string,state:string,options:array<struct<name:string,state:string>>>"
#: A rule gives this many findings in a file at most; what is left out is a gap, not silence.
MOST_IN_FILE = 5


@dataclass(frozen=True)
class Option:
    """A boolean option of a call: a keyword, or a property of an argument (its index, or ``all``); the rule asks for one of ``states``."""

    name: str
    location: str
    states: tuple[str, ...]
    argument: int | str | None = None

    def __post_init__(self):
        if self.location not in ("keyword", "argument") or not self.states or set(self.states) - set(STATES):
            raise ValueError("an option has a location (keyword or argument) and some of the states true, false, missing, unknown")
        if (self.location == "argument") != (self.argument == "all" or isinstance(self.argument, int)):
            raise ValueError("an option of an argument, and no other, names its index or all")


@dataclass(frozen=True)
class CallRule:
    """A call is a finding where all of this holds; patterns are regular expressions, found anywhere unless ``whole``."""

    rule_id: str
    languages: tuple[str, ...] = ()
    callee: str | None = None
    whole: bool = False
    receiver: str | None = None
    arguments: str | None = None
    index: int | None = None
    without: str | None = None
    missing: tuple[str, ...] = ()
    option: Option | None = None
    context: tuple[str, ...] = ()
    no_context: tuple[str, ...] = ()
    severity: str = "medium"
    confidence: float = 0.7
    disposition: str = "advisory"
    message: str = "{callee} at {file}:{line}"
    enabled: bool = field(default=True, compare=False)


def full_name() -> Column:
    return F.concat_ws(".", "receiver", "callee")


def _object_options(text: Column) -> Column:
    """The options of an object literal of one level: ``name: true`` and the like; a spread has no name, other values are unknown.  Null for other texts."""
    inner = F.regexp_extract(text, r"^\s*[&\w.]*\{(.*)\}\s*$", 1)
    parts = F.filter(F.transform(F.split(inner, r",(?![^\[({]*[\])}])"), lambda p: F.trim(p)), lambda p: p != "")

    def read(p: Column) -> Column:
        value = F.lower(F.trim(F.regexp_extract(p, r"^[^:]+:(.*)$", 1)))
        name = F.regexp_extract(p, r"""^["']?([\w-]+)["']?\s*(?::|\(|$)""", 1)
        return F.struct(F.when(name != "", name).alias("name"), F.when(value.isin("true", "false"), value).otherwise("unknown").alias("state"))

    return F.when(text.rlike(r"^\s*[&\w.]*\{.*\}\s*$"), F.transform(parts, read))


def argument_facts(arguments: Column) -> Column:
    """What the texts of a call's arguments say: (``kind``, ``name``, ``state``, ``options``) each.

    Kinds: ``keyword`` (``name=True``), ``keyword_spread`` (``**x``), ``spread`` (``*x``, ``...x``) and ``positional``.  ``options`` are those of an object
    literal; null where the argument is none, so its options are unknown."""

    def read(a: Column) -> Column:
        keyword = F.regexp_extract(a, r"^\s*([A-Za-z_]\w*)\s*=(?!=)", 1)
        value = F.lower(F.trim(F.regexp_extract(a, r"=(.*)$", 1)))
        spread = F.when(a.rlike(r"^\s*\*\*"), "keyword_spread").when(a.rlike(r"^\s*(\*|\.\.\.)"), "spread")
        kind = F.coalesce(spread, F.when(keyword != "", "keyword"), F.lit("positional"))
        state = F.when((kind == "keyword") & value.isin("true", "false"), value).otherwise("unknown")
        body = F.when(kind == "keyword_spread", F.regexp_replace(a, r"^\s*\*\*", "")).otherwise(a)
        return F.struct(kind.alias("kind"), F.nullif(keyword, F.lit("")).alias("name"), state.alias("state"), _object_options(body).alias("options"))

    return F.transform(arguments, read)


def _property(options: Column, name: str) -> Column:
    """The state of a property: the last one of the name; a spread behind it makes it unknown; null options are unknown."""
    step = lambda acc, o: F.when(o["name"].isNull(), "unknown").when(o["name"] == name, o["state"]).otherwise(acc)
    return F.when(options.isNull(), "unknown").otherwise(F.aggregate(options, F.lit("missing"), step))


def option_state(facts: Column, option: Option) -> Column:
    """``true``, ``false``, ``missing`` or ``unknown``.

    A keyword that may be bound twice is unknown.  An argument behind a spread is unknown; one that isn't there is missing.  Over all arguments
    false wins, then missing, then unknown; without arguments it is missing."""
    if option.location == "keyword":
        own = lambda f: (
            F.when((f["kind"] == "keyword") & (f["name"] == option.name), f["state"]).when(f["kind"] == "keyword_spread", _property(f["options"], option.name)).when(f["kind"] == "unknown", "unknown").otherwise("missing")
        )
        found = F.filter(F.transform(facts, own), lambda s: s != "missing")
        state = F.when(F.size(found) > 1, "unknown").otherwise(F.coalesce(F.get(found, 0), F.lit("missing")))
    elif option.argument == "all":
        states = F.transform(facts, lambda f: F.when(f["kind"] == "positional", _property(f["options"], option.name)).otherwise("unknown"))
        state = F.when(F.size(states) == 0, "missing")
        for s in ("false", "missing", "unknown"):
            state = state.when(F.array_contains(states, s), s)
        state = state.otherwise("true")
    else:
        k = int(option.argument)
        moved = F.exists(F.slice(facts, 1, k + 1), lambda f: f["kind"].isin("spread", "unknown"))
        state = F.when(moved, "unknown").when(F.size(facts) <= k, "missing").otherwise(_property(F.get(facts, k)["options"], option.name))
    return F.when(facts.isNull(), "unknown").otherwise(state)


def _said(message: str, state: Column) -> Column:
    """The message with what stands in braces filled in; names that are not known stay."""
    text = F.lit(message)
    values = {"callee": full_name(), "line": F.col("line").cast("string"), "file": F.col("file_path"), "source": F.coalesce(F.nullif(F.substring(F.array_join("arguments", " "), 1, 80), F.lit("")), full_name()), "option_state": state}
    for name, value in values.items():
        if "{" + name + "}" in message:
            text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def hit(rule: CallRule) -> tuple[Column, Column]:
    """Whether a call is a finding of a rule, and the state of the rule's option."""
    name, given = full_name(), F.size("arguments")
    text = F.array_join("arguments", " ") if rule.index is None else F.get("arguments", rule.index)
    ok, state = F.lit(True), F.lit("unmodeled")
    if rule.languages:
        ok &= F.col("language").isin(*rule.languages)
    if rule.callee and rule.callee not in (".*", ".+"):
        pattern = f"^(?:{rule.callee})$" if rule.whole else rule.callee
        ok &= name.rlike(pattern) | F.concat(name, F.lit("(")).rlike(pattern)
    if rule.receiver:
        ok &= F.coalesce(F.col("receiver").rlike(rule.receiver), F.lit(False))
    if rule.arguments or rule.without:
        ok &= given > 0
    if rule.index is not None:
        ok &= given > rule.index
    if rule.arguments:
        ok &= text.rlike(rule.arguments)
    if rule.without:
        ok &= ~text.rlike(rule.without)
    if rule.missing:
        # a finding unless all of them are there
        ok &= ~reduce(lambda a, b: a & b, (text.rlike(p) for p in rule.missing))
    if rule.option:
        state = option_state(F.col("facts"), rule.option)
        ok &= state.isin(*rule.option.states)
    for pattern in rule.context:
        ok &= F.col("context").rlike(pattern)
    for pattern in rule.no_context:
        ok &= ~F.col("context").rlike(pattern)
    return ok, state


def evaluate(calls: DataFrame, rules: Sequence[CallRule]) -> DataFrame:
    """``calls`` with ``rule_id``, ``severity``, ``confidence``, ``disposition``, ``message``: a row for each rule that a call is a finding of."""
    found = []
    for r in rules:
        if r.enabled:
            ok, state = hit(r)
            made = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.lit(r.disposition).alias("disposition"), _said(r.message, state).alias("message"))
            found.append(F.when(ok, made))
    if not found:
        raise ValueError("no rule is enabled")
    fired = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return calls.select("*", fired.alias("_f")).select(*calls.columns, "_f.*")


def capped(findings: DataFrame, order: Sequence[str], most: int = MOST_IN_FILE) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` findings of a rule in a file, and a gap (``rule_id``, ``file_path``, ``omitted``) for each of which more were left out."""
    keys = ["rule_id", "file_path"]
    counts = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return first_of(findings, keys, order, most), counts.select(*keys, (F.col("_n") - most).alias("omitted"))


def evaluated(rules: Sequence[CallRule], files: DataFrame) -> DataFrame:
    """``rule_id``, ``files``: the enabled rules that have files of their languages, and how many; a rule without languages has all."""
    spark = files.sparkSession
    rows = [(r.rule_id, x) for r in rules if r.enabled for x in (r.languages or ("*",))]
    asked = spark.createDataFrame(rows, "rule_id string, language string")
    per = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    every = per.agg(F.sum("n").alias("n")).select(F.lit("*").alias("language"), "n").filter("n is not null")
    return asked.join(per.union(every), "language").groupBy("rule_id").agg(F.sum("n").alias("files"))


# what calls mean for flows

#: Well-known entries and ends of flows in public APIs: language, kind, name, category.  A table of a user's own takes its place where it is given.
DICTIONARY = [
    ("python", "source", "request.args.get", "http"), ("python", "source", "request.form.get", "http"), ("python", "source", "os.getenv", "environment"), ("python", "source", "input", "console"),
    ("python", "sink", "cursor.execute", "sql"), ("python", "sink", "os.system", "command"), ("python", "sink", "subprocess.run", "command"), ("python", "sink", "requests.get", "url"), ("python", "sink", "open", "path"),
    ("python", "sanitizer", "shlex.quote", "command"), ("python", "sanitizer", "html.escape", "html"), ("python", "sanitizer", "int", "*"),
    ("java", "source", "request.getParameter", "http"), ("java", "source", "request.getHeader", "http"), ("java", "sink", "statement.executeQuery", "sql"), ("java", "sink", "Runtime.exec", "command"), ("java", "sanitizer", "Integer.parseInt", "*"),
    ("javascript", "source", "document.cookie", "browser"), ("javascript", "sink", "eval", "code"), ("javascript", "sink", "document.write", "html"), ("javascript", "sanitizer", "encodeURIComponent", "url"),
    ("go", "source", "os.Getenv", "environment"), ("go", "sink", "exec.Command", "command"), ("go", "sink", "db.Query", "sql"), ("go", "sanitizer", "html.EscapeString", "html"),
]
KINDS = ("source", "sink", "sanitizer")
#: A dictionary is broadcast; more entries are an error.
MOST_ENTRIES = 100_000


def dictionary(spark, entries: Sequence[tuple[str, str, str, str]] = tuple(DICTIONARY)) -> DataFrame:
    """``language``, ``kind``, ``name``, ``category``; a kind that is none, an empty name and too many entries are errors."""
    if len(entries) > MOST_ENTRIES or any(kind not in KINDS or not name for _, kind, name, _ in entries):
        raise ValueError(f"entries are sources, sinks or sanitizers with a name, {MOST_ENTRIES} at most")
    return spark.createDataFrame(sorted(set(entries)), "language string, kind string, name string, category string")


def marked(calls: DataFrame, names: DataFrame) -> DataFrame:
    """``calls`` with ``kind`` and ``category`` for every entry of their language that they mean: the full name, or its end behind a dot.

    The ends of a call's name are exploded, so it is an equi-join on (language, name); the dictionary is bounded and broadcast."""
    parts = F.split(full_name(), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    asked = calls.select("*", F.explode(ends).alias("_end"))
    entries = names.select(F.col("language").alias("_language"), F.col("name").alias("_name"), "kind", "category").distinct()
    return asked.join(F.broadcast(entries), (F.col("language") == F.col("_language")) & (F.col("_end") == F.col("_name"))).drop("_end", "_language", "_name").distinct()


def applied(calls: DataFrame, models: DataFrame) -> DataFrame:
    """What library models say of calls: a row for each model, with ``role``, ``moves_from``, ``moves_to``, ``category``.

    ``models``: ``role``, ``languages``, ``callee``, ``receivers`` (empty: any), ``inputs``, ``outputs``, ``category``.  A source gives its outputs, a sink takes its inputs, a propagator moves every input to
    every output, a sanitizer stops its category; ``-1`` is the receiver.  An input that the call does not have moves nothing."""
    rows = calls.join(F.broadcast(models.withColumnRenamed("callee", "_callee")), F.col("callee") == F.col("_callee"))
    fits = F.array_contains("languages", F.col("language")) & ((F.size("receivers") == 0) | F.coalesce(F.array_contains("receivers", F.col("receiver")), F.lit(False)))
    none = F.array(F.lit(None).cast("int"))
    there = F.filter("inputs", lambda i: (i < F.size("arguments")) & ((i >= 0) | F.col("receiver").isNotNull()))
    froms = F.when(F.col("role") == "source", none).otherwise(there)
    tos = F.when(F.col("role").isin("source", "propagator"), F.col("outputs")).otherwise(none)
    moved = rows.filter(fits).select(*calls.columns, "role", "category", F.explode(froms).alias("moves_from"), tos.alias("_to"))
    return moved.select(*calls.columns, "role", "category", "moves_from", F.explode("_to").alias("moves_to"))


def flow_findings(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of flows that end in a rule's category unsanitised: the flows with ``rule_id``, ``cwe``, ``severity``, ``disposition`` blocking and ``evidence_state`` reachable.

    ``flows``: ``category`` (of the sink), ``sanitized`` (the categories that were stopped, ``*`` all); ``rules``: ``rule_id``, ``category``, ``cwe``, ``severity``; bounded, as rules are."""
    open_ = flows.filter(~F.array_contains("sanitized", F.col("category")) & ~F.array_contains("sanitized", F.lit("*")))
    return open_.join(F.broadcast(rules), "category").select(*flows.columns, "rule_id", "cwe", "severity", F.lit("blocking").alias("disposition"), F.lit("reachable").alias("evidence_state"))


#: A string literal that begins with a scheme and a whole host, so that what follows can't change whom a request goes to.
FIXED_ORIGIN = r"""^\s*[fFrRbB]?["'`]https?://[^/"'`{}$@]+/"""
#: A text that is one string literal, with nothing put into it.
CONSTANT = r"""^\s*[rRbBuU]?("[^"{$]*"|'[^'{$]*'|`[^`{$]*`)\s*$"""


def without_fixed_origins(flows: DataFrame, sinks: DataFrame) -> DataFrame:
    """Flows whose line has a sink call that may go anywhere; one whose sink calls all have a literal origin is dropped, one without calls stays.

    ``flows`` and ``sinks``: ``file_path``, ``line``; ``sinks`` also ``arguments``."""
    fixed = sinks.groupBy("file_path", "line").agg(F.bool_and(F.coalesce(F.get("arguments", 0).rlike(FIXED_ORIGIN), F.lit(False))).alias("_fixed")).filter("_fixed")
    return flows.join(fixed.select("file_path", "line"), ["file_path", "line"], "left_anti")


def without_constant_queries(sinks: DataFrame) -> DataFrame:
    """Sink calls whose argument (``argument_index``, -1 the receiver) is not one constant; those that lack it stay."""
    chosen = F.when(F.col("argument_index") >= 0, F.get("arguments", F.col("argument_index"))).otherwise(F.col("receiver"))
    return sinks.filter(~F.coalesce(chosen.rlike(CONSTANT), F.lit(False)))


def unguarded(functions: DataFrame, marks: DataFrame, edges: DataFrame, base: float = 0.8, factor: float = 0.6) -> DataFrame:
    """``fn_id``, ``confidence``: entry functions that use a value unchecked.

    ``functions``: ``fn_id``, ``is_entry``; ``marks``: ``fn_id``, ``mark``: ``use`` (what needs the check), ``check`` (it is made), ``auth`` (callers are known); ``edges``: ``src``, ``dst`` of calls.
    Of those that have a use and no check the confidence is ``base``, times ``factor`` where the function, or a direct caller, has ``auth``."""
    has = lambda m: F.bool_or(F.col("mark") == m).alias(m)
    by = marks.groupBy("fn_id").agg(has("use"), has("check"), has("auth"))
    called = edges.join(by.filter("auth").select(F.col("fn_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("fn_id")).distinct().withColumn("_called", F.lit(True))
    rows = functions.filter("is_entry").join(by.filter("use and not check"), "fn_id").join(called, "fn_id", "left")
    return rows.select("fn_id", F.when(F.col("auth") | F.coalesce("_called", F.lit(False)), F.lit(base * factor)).otherwise(F.lit(base)).alias("confidence"))
