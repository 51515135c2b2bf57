"""Queries that evaluate rules and text functions over lines of source."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import rules as op
from lodestone.operators import source_rules
from lodestone.plans.registry import query

RULES = [
    op.LineRule("EMAIL", "[a-z]+[.][0-9]+@[a-z0-9.]+", severity="high"),
    op.LineRule("TOKEN", "token", excused="example", severity="critical", message="token in {file}"),
    op.LineRule("LICENSE", "(?i)licensed under", required="[0-9]"),
]


@query(
    "rl02_line_rules",
    """with r(rule_id, severity, message, hit) as (
      select 'EMAIL', 'high', 'match in doc' || doc_id, struct_pack(doc_id, line) from source_lines_v where regexp_matches(code, '[a-z]+[.][0-9]+@[a-z0-9.]+')
      union all select 'TOKEN', 'critical', 'token in doc' || doc_id, struct_pack(doc_id, line) from source_lines_v where contains(code, 'token') and not contains(code, 'example')
      union all select 'LICENSE', 'medium', 'match in doc' || doc_id, struct_pack(doc_id, line) from source_lines_v where regexp_matches(code, '(?i)licensed under') and regexp_matches(code, '[0-9]'))
    select hit.doc_id as doc_id, hit.line as line, rule_id, severity, message from r""",
)
def rl02(t):
    """RL01, RL02, RL03, RL07, RL12, RL17: several rules in one pass, with messages from templates."""
    return op.evaluate(t.source_lines_v, RULES).select("doc_id", "line", "rule_id", "severity", "message")


@query(
    "rl04_blocks_without",
    """with n as (select *, count(*) filter (contains(code, ' of ')) over (partition by doc_id order by line) as block from source_lines_v),
    e as (select *, coalesce(count(*) filter (contains(code, 'the')) over (partition by doc_id, block order by line rows between unbounded preceding and 1 preceding), 0) as ended from n where block > 0)
    select doc_id, min(line) as block_start, max(line) as block_end from e where ended = 0 group by doc_id, block having bool_or(contains(code, 'the')) and not bool_or(contains(code, 'with'))""",
)
def rl04(t):
    code = F.col("code")
    return op.blocks_without(t.source_lines_v, "doc_id", "line", F.contains(code, F.lit(" of ")), F.contains(code, F.lit("the")), F.contains(code, F.lit("with")))


@query(
    "rl06_sequences",
    """with m as (select doc_id, line, code, max(case when contains(code, ' of ') then line end) over w as first_line, max(case when contains(code, 'with') then line end) over w as unless
      from source_lines_v window w as (partition by doc_id order by line rows between unbounded preceding and 1 preceding))
    select doc_id, first_line, line as then_line from m where contains(code, ' to ') and first_line is not null and line - first_line <= 5 and (unless is null or unless <= first_line)""",
)
def rl06(t):
    code = F.col("code")
    return op.sequences(t.source_lines_v, "doc_id", "line", F.contains(code, F.lit(" of ")), F.contains(code, F.lit(" to ")), 5, F.contains(code, F.lit("with")))


@query("rl08_negative_check", "select doc_id, line from source_lines_v where regexp_matches(code, '(?i)license') and not regexp_matches(code, '[A-Z]{2,}')")
def rl08(t):
    return t.source_lines_v.filter(F.col("code").rlike("(?i)license") & ~F.col("code").rlike("[A-Z]{2,}")).select("doc_id", "line")


@query("rl09_numeric_threshold", "select doc_id, line, list_min(list_transform(regexp_extract_all(code, '[0-9]{1,9}'), lambda x: x::bigint)) as least from source_lines_v where regexp_matches(code, '[0-9]') and list_min(list_transform(regexp_extract_all(code, '[0-9]{1,9}'), lambda x: x::bigint)) < 100")
def rl09(t):
    least = F.array_min(F.transform(F.regexp_extract_all("code", F.lit("[0-9]{1,9}"), F.lit(0)), lambda x: x.cast("long")))
    return t.source_lines_v.filter(F.col("code").rlike("[0-9]")).select("doc_id", "line", least.alias("least")).filter("least < 100")


@query(
    "rl10_entropy",
    """with t as (select doc_id, line, unnest(regexp_extract_all(code, '[A-Za-z0-9]{20,}')) as word from source_lines_v), d as (select distinct doc_id, line, word from t),
    c as (select doc_id, line, word, unnest(string_split(word, '')) as c from d), n as (select doc_id, line, word, c, count(*) as k from c where c <> '' group by all)
    select doc_id, line, word, round(-sum(k / length(word)::double * log2(k / length(word)::double)), 6) as bits from n group by all having bits > 3""",
)
def rl10(t):
    """RL10, AG19: token-like words by the entropy of their characters."""
    words = t.source_lines_v.filter(F.col("code").rlike("[A-Za-z0-9]{20,}")).select("doc_id", "line", F.explode(F.regexp_extract_all("code", F.lit("[A-Za-z0-9]{20,}"), F.lit(0))).alias("word")).distinct()
    return words.withColumn("bits", F.round(fn.entropy(F.col("word")), 6)).filter("bits > 3")


@query("rl18_fixture_suite", "select rule_id, count(*) filter (expected and actual) as tp, count(*) filter (not expected and actual) as fp, count(*) filter (expected and not actual) as fn from (select rule_id, k_part % 7 = 0 as expected, confidence > 0.8 as actual from findings_v) group by 1")
def rl18(t):
    rows = t.findings_v.select("rule_id", (F.col("k_part") % 7 == 0).alias("e"), (F.col("confidence") > 0.8).alias("a"))
    return rows.groupBy("rule_id").agg(F.count_if(F.col("e") & F.col("a")).alias("tp"), F.count_if(~F.col("e") & F.col("a")).alias("fp"), F.count_if(F.col("e") & ~F.col("a")).alias("fn"))


@query("flt14_line_search", "select doc_id, line from source_lines_v where contains(code, 'Licensed')")
def flt14(t):
    return t.source_lines_v.filter(F.contains("code", F.lit("Licensed"))).select("doc_id", "line")


@query("flt15_prefix_page", "select distinct file_path from findings_v where starts_with(file_path, 'src/m1') order by 1 limit 25 offset 2")
def flt15(t):
    """A page of 25 is the feature."""
    return t.findings_v.filter(F.col("file_path").startswith("src/m1")).select("file_path").distinct().orderBy("file_path").offset(2).limit(25)


@query(
    "fn01_scrubbed_strings",
    """select page_id, length(html) as before, sha256(array_to_string(list_transform(string_split(html, '"'), lambda p, i: case when i % 2 = 0 then repeat(' ', length(p)) else p end), '"')) as scrubbed from pages""",
)
def fn01(t):
    clean = fn.scrub_strings(F.col("html"))
    return t.pages.select("page_id", F.length("html").cast("long").alias("before"), F.sha2(clean, 256).alias("scrubbed"))


def _redacted(sql: str) -> str:
    for pattern in fn.SECRET_PATTERNS:
        sql = f"regexp_replace({sql}, '{pattern}', '{fn.REDACTED}', 'g')"
    return sql


@query("fn07_redaction", f"select doc_id, sha256({_redacted('text')}) as clean from documents")
def fn07(t):
    return t.documents.select("doc_id", F.sha2(fn.redact(F.col("text")), 256).alias("clean"))


@query(
    "fn13_snippets",
    """select doc_id, line, array_to_string(list(code) over w, chr(10)) as snippet, min(line) over w as start from source_lines_v window w as (partition by doc_id order by line rows between 2 preceding and 2 following) qualify contains(code, 'Licensed')""",
)
def fn13(t):
    return op.snippets(t.source_lines_v, t.source_lines_v.filter(F.contains("code", F.lit("Licensed"))), "doc_id", "line", "code", 2)


@query("fn14_scores", "select event_type, case when value / 10 >= 9 then 'critical' when value / 10 >= 7 then 'high' when value / 10 >= 4 then 'medium' else 'low' end as severity, count(*) as n from events group by 1, 2")
def fn14(t):
    return t.events.groupBy("event_type", fn.severity_of(F.col("value") / 10).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("fn15_cwe", "select p_partkey, regexp_extract(lower('tag,CWE-0' || p_size || ',x'), 'cwe[-_/]?0*([0-9]+)', 1) as cwe from part")
def fn15(t):
    return t.part.select("p_partkey", fn.cwe(F.concat(F.lit("tag,CWE-0"), F.col("p_size").cast("string"), F.lit(",x"))).alias("cwe"))


@query("fn20_ratio", "select event_type, round(sum(value) / nullif(count(*) filter (value > 95), 0), 6) as ratio from events group by 1")
def fn20(t):
    return t.events.groupBy("event_type").agg(F.round(fn.safe_ratio(F.sum("value"), F.count_if(F.col("value") > 95)), 6).alias("ratio"))


@query("fn27_json_props", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def fn27(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn28_days", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, regexp_full_match(strftime(o_orderdate, '%Y-%m-%d'), '[0-9]{4}-[0-9]{2}-[0-9]{2}') as valid from orders")
def fn28(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    valid = day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.date_format(F.to_date(day), "yyyy-MM-dd") == day)
    return t.orders.select("o_orderkey", day.alias("day"), valid.alias("valid"))


@query("fn29_tags", "select p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(lower(p_type), ' '), lambda x: trim(x)), lambda x: x <> '')))[1:20], ',') as tags from part")
def fn29(t):
    tags = F.array_distinct(F.filter(F.transform(F.split(F.lower("p_type"), " "), lambda x: F.trim(x)), lambda x: x != ""))
    return t.part.select("p_partkey", F.array_join(F.slice(F.array_sort(tags), 1, 20), ",").alias("tags"))


#: Line breaks before a place, and how far it is from the last one; strings are counted from 1.
PLACED = "length(head) - length(replace(head, chr(10), '')) + 1 as line, start - coalesce(length(head) - instr(reverse(head), chr(10)) + 1, 0) * (instr(head, chr(10)) > 0)::int + 1 as col"


@query(
    "rl03_source_rules",
    f"""with recursive d as (select doc_id, text from documents where text <> ''), one as (select doc_id, text, instr(text, 'tion') - 1 as start from d where instr(text, 'tion') > 0 and instr(text, 'ing') > 0 and instr(text, 'zzz') = 0),
      two as (select doc_id, text, start + 4 + instr(substr(text, start + 5), 'tion') - 1 as start from one where instr(substr(text, start + 5), 'tion') > 0), f as (select * from one union all select * from two),
      h as (select doc_id, start, substr(text, 1, start) as head from f)
    select doc_id, 'R-pair' as rule_id, {PLACED}, start::int as start from h""",
)
def rl03(t):
    """RL03, RL07: the first two places of one pattern in texts that also match another and not a third, with line and column."""
    rule = source_rules.SourceRule("R-pair", primary=("tion", "ing"), excluded=("zzz",))
    return source_rules.evaluate(t.documents, [rule], "doc_id", "text").select("doc_id", "rule_id", "line", "col", "start")


@query(
    "rl05_window_before",
    """with recursive r(doc_id, text, start) as (select doc_id, text, instr(text, 'Th') from documents where instr(text, 'Th') > 0
      union all select doc_id, text, start + 1 + instr(substr(text, start + 2), 'Th') from r where instr(substr(text, start + 2), 'Th') > 0),
      b as (select doc_id, start, text, case when start > 2 and instr(substr(text, 1, start - 2), chr(10)) > 0 then start - 2 - instr(reverse(substr(text, 1, start - 2)), chr(10)) else -1 end as above from r),
      w as (select doc_id, start, substr(text, (greatest(0, above - 500) + 1)::bigint, (start - 1 - greatest(0, above - 500))::bigint) as prefix from b),
      k as (select *, row_number() over (partition by doc_id order by start) as nth from w where instr(prefix, 'ent') = 0)
    select doc_id, (start - 1)::int as start from k where nth <= 2""",
)
def rl05(t):
    """RL05: definitions without a guard in the 500 characters before the line above them."""
    rule = source_rules.SourceRule("R-guard", definition="Th", guard="ent")
    return source_rules.evaluate(t.documents, [rule], "doc_id", "text").select("doc_id", "start")
