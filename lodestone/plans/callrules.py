"""Queries of rules over calls: patterns, options, dictionaries, models, flows and missing checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import calls as op
from lodestone.plans.registry import query
from lodestone.sources import rulefiles

ROW = ["k_order", "k_line", "k_part", "k_supp", "k_price"]
R = ", ".join(ROW)
CALLEES = ["execute", "set_cookie", "get", "open", "escape", "run"]
RECEIVERS = ["cursor", "response", "requests", None, "html", "subprocess"]
LANGUAGES = ["python", "typescript", "java", "go"]
ARGUMENTS = [
    ["'id'", "httponly=True", "secure=False"],
    ["sql + name"],
    ['"https://h.org/a/" + id', "{ secure: true, ...rest }", "timeout=3"],
    [],
    ["url", '{ "secure": false, path: p }', "*more", "{ secure: true }"],
]


def _sql(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]" if value else "[]::varchar[]"
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


SITES = f"""s as (select {R}, file_path, line, ({_sql(LANGUAGES)})[k_supp % 4 + 1] as language, ({_sql(CALLEES)})[k_part % 6 + 1] as callee, ({_sql(RECEIVERS)})[k_part % 6 + 1] as receiver,
    (k_order % 5)::int as form, case k_order % 5 when 0 then {_sql(ARGUMENTS[0])} when 1 then {_sql(ARGUMENTS[1])} when 2 then {_sql(ARGUMENTS[2])} when 3 then {_sql(ARGUMENTS[3])} else {_sql(ARGUMENTS[4])} end as arguments from calls_v)"""

RULE_FILE = r"""{"rules": [
  {"id": "SQL", "languages": ["python", "cobol"], "callee": "execute\\($", "args_match": "\\+", "severity": "high", "message": "{callee} of {source} in {file}"},
  {"id": "COOKIE", "callee": "response\\.set_cookie", "boolean_option": {"name": "secure", "location": "keyword", "states": ["false", "missing"]}, "message": "secure is {option_state} at {line}"},
  {"id": "TLS", "callee": "run", "option": {"name": "secure", "location": "argument", "argument": 1, "states": ["unknown", "false"]}},
  {"id": "TIMEOUT", "callee": "requests.get", "whole": true, "missing_args": ["timeout"], "confidence": 0.4},
  {"id": "OFF", "callee": ".*", "enabled": false}, {"id": "COBOL", "callee": ".*", "languages": ["cobol"]}]}"""


def _sites(t):
    literal = lambda values: F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")
    at = lambda values, k: F.get(literal(values), k.cast("int"))
    form = F.col("k_order") % 5
    arguments = F.when(form == 0, literal(ARGUMENTS[0]))
    for k in (1, 2, 3):
        arguments = arguments.when(form == k, literal(ARGUMENTS[k]))
    return t.calls_v.select(
        *ROW, "file_path", "line", at(LANGUAGES, F.col("k_supp") % 4).alias("language"), at(CALLEES, F.col("k_part") % 6).alias("callee"), at(RECEIVERS, F.col("k_part") % 6).alias("receiver"),
        form.cast("int").alias("form"), arguments.otherwise(literal(ARGUMENTS[4])).alias("arguments"),
    )


FIRED = f"""{SITES}, f as (
    select {R}, file_path, line, 'SQL' as rule_id, 'high' as severity, 0.7 as confidence, 'cursor.execute of ' || array_to_string(arguments, ' ')[:80] || ' in ' || file_path as message from s where language = 'python' and callee = 'execute' and contains(array_to_string(arguments, ' '), '+')
    union all select {R}, file_path, line, 'COOKIE', 'medium', 0.7, 'secure is ' || case form when 0 then 'false' else 'missing' end || ' at ' || line from s where callee = 'set_cookie'
    union all select {R}, file_path, line, 'TLS', 'medium', 0.7, 'subprocess.run at ' || file_path || ':' || line from s where callee = 'run' and form in (0, 2, 4)
    union all select {R}, file_path, line, 'TIMEOUT', 'medium', 0.4, 'requests.get at ' || file_path || ':' || line from s where callee = 'get' and form <> 2)"""


def _fired(t):
    rules, problems = rulefiles.load([("rules.json", RULE_FILE)])
    if problems:
        raise ValueError(problems)
    return op.evaluate(_sites(t).withColumn("facts", op.argument_facts(F.col("arguments"))), rules)


@query("rl02_call_rules", f"with {FIRED} select {R}, rule_id, severity, confidence::double as confidence, message from f")
def rl02(t):
    """RL01, RL02, RL12, SRC34, UD01-03: rules of a file over calls in one pass: languages, names, arguments, options, messages."""
    return _fired(t).select(*ROW, "rule_id", "severity", "confidence", "message")


@query(
    "wn04_capped_rules",
    f"with {FIRED}, n as (select *, row_number() over (partition by rule_id, file_path order by line, {R}) as nth, count(*) over (partition by rule_id, file_path) as total from f) select rule_id, file_path, count(*) filter (nth <= 5) as kept, sum(line) filter (nth <= 5)::bigint as lines, max(greatest(total - 5, 0)) as omitted from n group by 1, 2",
)
def wn04(t):
    """Five findings of a rule in a file, and what was left out."""
    kept, gaps = op.capped(_fired(t), ["line", *ROW])
    rows = kept.groupBy("rule_id", "file_path").agg(F.count(F.lit(1)).alias("kept"), F.sum("line").alias("lines"))
    return rows.join(gaps, ["rule_id", "file_path"], "left").select("rule_id", "file_path", "kept", "lines", F.coalesce("omitted", F.lit(0)).alias("omitted"))


@query(
    "rl01_evaluated",
    "with f as (select file_path, case when file_path like '%.py' then 'python' when file_path like '%.ts' then 'typescript' when file_path like '%.java' then 'java' else 'go' end as language from (select distinct file_path from calls_v)) select rule_id, count(*) as files from f, (values ('SQL', 'python'), ('COOKIE', null), ('TLS', null), ('TIMEOUT', null)) r(rule_id, asked) where asked is null or asked = language group by 1",
)
def rl01(t):
    files = _sites(t).select("file_path", "language").distinct()
    return op.evaluated(rulefiles.load([("rules.json", RULE_FILE)])[0], files)


@query(
    "tn13_argument_facts",
    f"""with {SITES}, e(form, facts) as (values (0, 'positional::unknown:-,keyword:httponly:true:-,keyword:secure:false:-'), (1, 'positional::unknown:-'), (2, 'positional::unknown:-,positional::unknown:secure=true/*=unknown,keyword:timeout:unknown:-'), (3, ''),
      (4, 'positional::unknown:-,positional::unknown:secure=false/path=unknown,spread::unknown:-,positional::unknown:secure=true'))
    select {R}, facts from s join e using (form)""",
)
def tn13(t):
    """Keywords, spreads and the options of object literals of every call."""
    shown = lambda f: F.concat_ws(":", f["kind"], F.coalesce(f["name"], F.lit("")), f["state"], F.coalesce(F.array_join(F.transform(f["options"], lambda o: F.concat(F.coalesce(o["name"], F.lit("*")), F.lit("="), o["state"])), "/"), F.lit("-")))
    return _sites(t).select(*ROW, F.array_join(F.transform(op.argument_facts(F.col("arguments")), shown), ",").alias("facts"))


@query("tn14_option_states", f"with {SITES}, e(form, keyword, second, every) as (values (0, 'false', 'unknown', 'unknown'), (1, 'missing', 'missing', 'unknown'), (2, 'missing', 'unknown', 'unknown'), (3, 'missing', 'missing', 'missing'), (4, 'missing', 'false', 'false')) select {R}, keyword, second, every from s join e using (form)")
def tn14(t):
    """The option ``secure`` as a keyword, as a property of the second argument, and of all."""
    rows = _sites(t).withColumn("facts", op.argument_facts(F.col("arguments")))
    state = lambda **where: op.option_state(F.col("facts"), op.Option("secure", states=op.STATES, **where))
    return rows.select(*ROW, state(location="keyword").alias("keyword"), state(location="argument", argument=1).alias("second"), state(location="argument", argument="all").alias("every"))


MARKS = "d(language, callee, kind, category) as (values ('python', 'execute', 'sink', 'sql'), ('python', 'run', 'sink', 'command'), ('python', 'get', 'sink', 'url'), ('python', 'open', 'sink', 'path'), ('python', 'escape', 'sanitizer', 'html'))"


@query("tn01_seeds", f"with {SITES}, {MARKS} select {R}, kind, category from s join d using (language, callee)")
def tn01(t):
    """SRC32, TN01: what the default dictionary knows of each call."""
    return op.marked(_sites(t), op.dictionary(t.spark)).select(*ROW, "kind", "category")


@query(
    "tn06_library_model",
    f"""with {SITES} select {R}, 'source' as role, null::int as moves_from, -1 as moves_to from s where callee = 'get' and receiver = 'requests' and language in ('python', 'go')
    union all select {R}, 'sink', i, null from s, (values (0), (-1)) v(i) where callee = 'execute' and language = 'python' and i < len(arguments)
    union all select {R}, 'propagator', i, o from s, (values (0), (2)) v(i), (values (-1), (1)) w(o) where callee = 'open' and i < len(arguments)
    union all select {R}, 'sanitizer', 0, null from s where callee = 'escape' and language = 'java' and len(arguments) > 0""",
)
def tn06(t):
    """Sources, sinks, propagators and sanitizers of a library, applied to arguments and receivers."""
    every = LANGUAGES
    models = [("source", ["python", "go"], "get", ["requests"], [], [-1], "http"), ("sink", ["python"], "execute", [], [0, -1], [], "sql"), ("propagator", every, "open", [], [0, 2], [-1, 1], "*"), ("sanitizer", ["java"], "escape", [], [0], [], "html")]
    frame = t.spark.createDataFrame(models, "role string, languages array<string>, callee string, receivers array<string>, inputs array<int>, outputs array<int>, category string")
    return op.applied(_sites(t), frame).select(*ROW, "role", "moves_from", "moves_to")


@query("rl13_builtin_flows", f"with {SITES}, {MARKS}, r(category, rule_id, cwe) as (values ('sql', 'SQLI', 89), ('command', 'CMDI', 78), ('path', 'PATH', 22), ('url', 'SSRF', 918)) select {R}, rule_id, cwe, 'blocking' as disposition from s join d using (language, callee) join r using (category) where kind = 'sink' and k_supp % 3 = 2")
def rl13(t):
    """RL11, RL13: flows into a rule's category that nothing sanitises on the way."""
    rules = t.spark.createDataFrame([("sql", "SQLI", 89, "critical"), ("command", "CMDI", 78, "critical"), ("path", "PATH", 22, "high"), ("url", "SSRF", 918, "high")], "category string, rule_id string, cwe int, severity string")
    k = F.col("k_supp") % 3
    stopped = F.when(k == 0, F.array(F.lit("*"))).when(k == 1, F.array("category")).otherwise(F.array(F.lit("html")))
    flows = op.marked(_sites(t), op.dictionary(t.spark)).filter("kind = 'sink'").withColumn("sanitized", stopped)
    return op.flow_findings(flows, rules).select(*ROW, "rule_id", "cwe", "disposition")


@query("flt11_literal_origin", f"with {SITES}, l as (select file_path, line, bool_and(form = 2) as fixed from s where callee = 'get' group by 1, 2) select file_path, line, count(*) as flows from s left join l using (file_path, line) where not coalesce(fixed, false) group by 1, 2")
def flt11(t):
    """Flows on lines all of whose requests go to a literal origin are dropped."""
    rows = _sites(t)
    return op.without_fixed_origins(rows, rows.filter("callee = 'get'")).groupBy("file_path", "line").agg(F.count(F.lit(1)).alias("flows"))


@query("flt12_constant_queries", f"with {SITES} select {R} from s where callee = 'execute' and not (form = 0 and k_part % 2 = 0)")
def flt12(t):
    """Queries that are one constant are no sinks; half of the calls are asked for an argument that they lack or that is none."""
    return op.without_constant_queries(_sites(t).filter("callee = 'execute'").withColumn("argument_index", F.when(F.col("k_part") % 2 == 0, 0).otherwise(-1))).select(*ROW)


GUARDS = """m as (select k_part as fn_id, bool_or(callee = 'execute' and k_line % 2 = 0) as uses, bool_or(callee = 'execute' and k_line = 5) as checks, bool_or(k_line = 6) as auth from s group by 1)"""


@query("rl15_unchecked_access", f"with {SITES}, {GUARDS} select fn_id, case when auth or exists (select 1 from edges_v e join m g on g.fn_id = e.src where e.dst = f.fn_id and overlay = 'call' and g.auth) then 0.8 * 0.6 else 0.8 end::double as confidence from functions_v f join m using (fn_id) where f.name in ('f0', 'f6', 'f12', 'f18', 'f24', 'f30') and uses and not checks")
def rl15(t):
    """RL15, RL16: entry functions whose use of a value no check precedes; a caller that is known scales the confidence."""
    calls = _sites(t)
    mark = lambda where, name: calls.filter(where).select(F.col("k_part").alias("fn_id"), F.lit(name).alias("mark"))
    marks = mark("callee = 'execute' and k_line % 2 = 0", "use").union(mark("callee = 'execute' and k_line = 5", "check")).union(mark("k_line = 6", "auth"))
    functions = t.functions_v.select("fn_id", F.col("name").isin("f0", "f6", "f12", "f18", "f24", "f30").alias("is_entry"))
    return op.unguarded(functions, marks, t.edges_v.filter("overlay = 'call'").select("src", "dst"))
