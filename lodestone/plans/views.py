"""Evidence relations derived from the sample tables, for Spark and for the SQL that checks it.

Each view is one projection; ``{name}`` stands for a table or another view."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_FILE = """concat('src/m', cast(l_suppkey % 20 as string), case l_suppkey % 4 when 0 then '.py' when 1 then '.ts' when 2 then '.java' else '.go' end)"""
_SUFFIX = """case p_partkey % 4 when 0 then '.py' when 1 then '.ts' when 2 then '.java' else '.go' end"""

VIEWS = {
    "projects_v": "select c_custkey as project_id, c_name as name, c_nationkey as owner_id from {customer}",
    "members_v": """select c_custkey as project_id, c_nationkey as user_id,
        case c_custkey % 4 when 0 then 'viewer' when 1 then 'triager' when 2 then 'maintainer' else 'admin' end as role from {customer}""",
    "scans_v": """select o_orderkey as scan_id, o_custkey as project_id, case when o_orderkey % 5 = 0 then 'dev' else 'main' end as branch,
        case o_orderstatus when 'F' then 'completed' when 'O' then 'partial' else 'running' end as status, o_orderdate as created_at from {orders}""",
    "findings_v": f"""select l_orderkey as scan_id, l_linenumber as k_line, l_partkey as k_part, l_suppkey as k_supp, l_extendedprice as k_price,
        concat('R', lpad(cast(l_partkey % 40 as string), 3, '0')) as rule_id,
        case l_partkey % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as severity,
        round(1 - l_discount * 8, 4) as confidence,
        case when l_returnflag = 'R' then 'blocking' else 'advisory' end as disposition,
        case when l_linestatus = 'O' then 'candidate' else 'reachable' end as evidence_state,
        {_FILE} as file_path, cast((l_partkey * 7) % 400 + 1 as int) as line_start,
        cast((l_partkey * 7) % 400 + 1 + cast(l_quantity as int) % 6 as int) as line_end,
        concat('unsafe call at line ', cast((l_partkey * 7) % 400 + 1 as string)) as message, l_shipdate as created_at from {{lineitem}}""",
    "functions_v": f"""select p_partkey as fn_id, concat('pkg.m', cast(p_partkey % 20 as string), '.f', cast(p_partkey as string)) as qualified_name,
        concat('f', cast(p_partkey % 50 as string)) as name, concat('src/m', cast(p_partkey % 20 as string), {_SUFFIX}) as file_path,
        cast((p_partkey * 13) % 400 + 1 as int) as line_start, cast((p_partkey * 13) % 400 + 1 + p_size as int) as line_end from {{part}}""",
    "calls_v": f"""select l_orderkey as k_order, l_linenumber as k_line, l_partkey as k_part, l_suppkey as k_supp, l_extendedprice as k_price,
        concat('f', cast(l_partkey % 50 as string)) as callee, {_FILE} as file_path,
        cast((l_partkey * 7) % 400 + 1 as int) as line, cast(l_linenumber as int) as col from {{lineitem}}""",
    "edges_v": """select a.l_partkey as src, b.l_partkey as dst, min(a.l_orderkey * 10 + a.l_linenumber) as callsite_id,
        case a.l_linenumber % 3 when 0 then 'cfg' when 1 then 'call' else 'semantic' end as overlay
        from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 group by 1, 2, 4""",
    "endpoints_v": """select page_id, concat('repo', cast(page_id % 3 as string)) as repository_id,
        case page_id % 3 when 0 then 'GET' when 1 then 'POST' else 'ALL' end as method,
        regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') as path, page_id % 2 = 0 as auth_required from {pages}""",
    "observations_v": """select event_id, ts, user_id as trace_id, event_type as kind,
        case event_type when 'view' then 'GET' when 'click' then 'GET' else 'POST' end as method,
        case when event_type = 'error' then 500 else 200 end as status_code, value as duration_ms,
        lag(event_id) over (partition by user_id order by ts, event_id) as parent_event_id from {events}""",
    "labelled_v": """select d.doc_id, l.quality = 1 as positive, d.n_chars > 1500 as detected, l.toxic, d.lang
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "turns_v": "select conv_id, turn, role, length(text) as n_chars from {conversations}",
    "client_calls_v": """select page_id, pos + 1 as ord, href as raw_url from {pages} lateral view posexplode(regexp_extract_all(html, 'href="([^"]+)"', 1)) t as pos, href""",
    "source_lines_v": r"""select doc_id, pos + 1 as line, txt as code from {documents} lateral view posexplode(split(text, '\\n')) t as pos, txt""",
    "routes_v": """select distinct 'repo0' as repository_id, 'ALL' as method, regexp_replace(path, '[0-9]+$', '{{id}}') as path from {endpoints_v}
        union select distinct 'repo1', 'GET', raw_url from {client_calls_v} where page_id % 2 = 0""",
    "code_v": """select l_orderkey as fn, l_orderkey * 10 + l_linenumber as stmt, min(l_partkey % 6) as kind, min(l_suppkey) as k from {lineitem} group by 1, 2""",
    # each line of an order a statement with clauses; where the supplier is odd, the rest of the order lies in its last clause
    "nested_v": """with c as (select fn, stmt, kind, k, stmt % 10 * 100 as pos, case when kind < 4 and k % 2 = 1 then 1000 - stmt % 10 * 2 else stmt % 10 * 100 + 100 end as upto from {code_v})
        select fn, stmt * 10 as id, case kind when 0 then 'if' when 1 then 'loop' when 2 then 'switch' when 3 then 'try' else 'plain' end as kind, pos as first, upto as last from c
        union all select fn, stmt * 10 + 1, case kind when 0 then 'then' when 2 then 'case' else 'guarded' end, pos + 10, pos + 20 from c where kind in (0, 2, 3)
        union all select fn, stmt * 10 + 2, case floor(k / 10) % 5 when 0 then 'plain' when 1 then 'return' when 2 then 'break' when 3 then 'continue' else 'throw' end, pos + 11, pos + 12 from c where kind in (0, 2, 3)
        union all select fn, stmt * 10 + 3, case kind when 0 then 'otherwise' when 1 then 'body' when 2 then 'default' else case when k % 4 < 2 then 'catch' else 'finally' end end, pos + 20, upto - 1 from c where kind < 4
        union all select fn, stmt * 10 + 4, case floor(k / 2) % 5 when 0 then 'plain' when 1 then 'return' when 2 then 'break' when 3 then 'continue' else 'throw' end, pos + 21, pos + 22 from c where kind < 4""",
    "client_paths_v": """select concat('p', cast(page_id as string)) as call_id, 'GET' as method, path as client_path from {endpoints_v}
        union all select concat('h', cast(page_id as string), '_', cast(ord as string)), 'GET', raw_url from {client_calls_v}""",
}

#: The same views where the dialects differ.
DUCK = {
    "client_calls_v": """select page_id, ord, href as raw_url from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href,
        generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) as ord from {pages})""",
    "source_lines_v": """select doc_id, line, txt as code from (select doc_id, unnest(string_split(text, chr(10))) as txt,
        generate_subscripts(string_split(text, chr(10)), 1) as line from {documents})""",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names_in(sql)})


def duck(body: str) -> str:
    """``body`` in DuckDB's dialect, after the views whose names it holds."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in names_in(DUCK.get(name, VIEWS[name])):
            if n in VIEWS:
                need(n)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            need(name)
    if not order:
        return body
    text = [f"{n} as ({reduce(lambda s, t: s.replace('{' + t + '}', t), [*TABLES, *VIEWS], DUCK.get(n, VIEWS[n])).replace('{{', '{').replace('}}', '}')})" for n in order]
    body = body.strip()
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    rest = body[head.end() :] if head else None
    recursive = "recursive " if head and head[1] else ""
    return f"with {recursive}{', '.join(text)}" + (f", {rest}" if head else f" {body}")
