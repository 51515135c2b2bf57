"""Queries that resolve calls by tiers, overloads and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import resolution as op
from lodestone.plans.registry import query

CALL = ["k_order", "k_line", "k_part", "k_supp", "k_price"]
C = ", ".join(CALL)


@query(
    "jn02_tiered_resolution",
    f"""with c as (select *, case when k_line % 3 = 0 then 'm' || (k_part % 20) when k_line % 3 = 1 then 'pkg.m' || (k_supp % 20) end as receiver from calls_v),
    q as (select *, case when receiver is null then callee else receiver || '.' || callee end as text from c), i as (select fn_id, 'src/m' || (fn_id % 20) || '.py' as file_path, 'm' || (fn_id % 7) || '.f' || (fn_id % 50) as binding, fn_id % 5 <> 0 as known from functions_v),
    t1 as (select file_path, binding as text, count(distinct fn_id) as n, min(fn_id) as id from i where known group by 1, 2), w as (select distinct file_path, split_part(binding, '.', 1) as word from i),
    t2 as (select file_path, 'm' || (fn_id % 20) || '.f' || fn_id as text, count(distinct fn_id) as n, min(fn_id) as id from functions_v group by 1, 2),
    t3 as (select file_path, name, count(distinct fn_id) as n, min(fn_id) as id from functions_v group by 1, 2), t4 as (select name, count(distinct fn_id) as n, min(fn_id) as id from functions_v group by 1),
    t5 as (select suffix, count(distinct fn_id) as n, min(fn_id) as id from (select unnest([qualified_name, regexp_replace(qualified_name, '^[^.]*[.]', ''), regexp_replace(qualified_name, '^.*[.]', '')]) as suffix, fn_id from functions_v) group by 1),
    r as (select q.*, w.word is not null and t1.n is null as outside, case when t1.n is not null then 'import' when t2.n is not null then 'qualified' when t3.n is not null then 'local' when t4.n is not null then 'global' when t5.n is not null then 'suffix' end as t,
        case when t1.n is not null then [t1.n, t1.id] when t2.n is not null then [t2.n, t2.id] when t3.n is not null then [t3.n, t3.id] when t4.n is not null then [t4.n, t4.id] when t5.n is not null then [t5.n, t5.id] end as hit
      from q left join t1 on t1.file_path = q.file_path and t1.text = q.text left join t2 on q.receiver is not null and t2.file_path = q.file_path and t2.text = q.text left join t3 on t3.file_path = q.file_path and t3.name = callee
        left join t4 on t4.name = callee left join t5 on t5.suffix = callee left join w on w.file_path = q.file_path and w.word = split_part(q.text, '.', 1))
    select {C}, case when outside then 'external' else t end as tier, case when not outside and hit[1] = 1 then hit[2] end as fn_id from r""",
)
def jn02(t):
    """All five tiers, with calls into what a file imports from elsewhere."""
    receiver = F.when(F.col("k_line") % 3 == 0, F.concat(F.lit("m"), (F.col("k_part") % 20).cast("string"))).when(F.col("k_line") % 3 == 1, F.concat(F.lit("pkg.m"), (F.col("k_supp") % 20).cast("string")))
    number = lambda n: (F.col("fn_id") % n).cast("string")
    imports = t.functions_v.select(F.concat(F.lit("src/m"), number(20), F.lit(".py")).alias("file_path"), F.concat(F.lit("m"), number(7), F.lit(".f"), number(50)).alias("binding"), F.when(F.col("fn_id") % 5 != 0, F.col("fn_id")).alias("fn_id"))
    return op.resolve(t.calls_v.withColumn("receiver", receiver), t.functions_v, imports).select(*CALL, "tier", "fn_id")


TYPES = ["int", "java.util.List<String>", "Long", "double", "String", "char"]
GIVEN = ["Integer", "byte", "String", "null", "java.lang.Long", "", "char"]


@query(
    "jn03_overloads",
    f"""with f as (select p_partkey as fn_id, 'f' || (p_partkey % 50) as name, 'repo' || (p_partkey % 3) as repo, 'C' || (p_partkey % 7) as class, list_transform(range(p_size % 4), lambda i: (p_partkey + i) % 6) as params, p_size % 5 = 0 as last_optional, p_size % 11 = 0 as varies from part),
    c as (select k_order, k_line, k_part, k_supp, k_price, callee as name, 'repo' || (k_supp % 3) as repo, case when k_line % 3 = 0 then 'C' || (k_supp % 7) end as receiver, case when k_order % 9 < 7 then 'C' || (k_order % 9) end as caller, list_transform(range(k_line % 4), lambda i: (k_order + i) % 7) as args from calls_v),
    bare(kind, k, t) as (values ('p', 0, 'int'), ('p', 1, 'List'), ('p', 2, 'long'), ('p', 3, 'double'), ('p', 4, 'string'), ('p', 5, 'char'), ('a', 0, 'int'), ('a', 1, 'byte'), ('a', 2, 'string'), ('a', 3, 'null'), ('a', 4, 'long'), ('a', 5, ''), ('a', 6, 'char')),
    w(t, u) as (values ('byte', 'int'), ('byte', 'long'), ('byte', 'double'), ('int', 'long'), ('int', 'double'), ('long', 'double'), ('char', 'int'), ('char', 'long'), ('char', 'double'), ('null', 'List'), ('null', 'string')),
    fit as (select a.k as a, p.k as p, case when a.t = '' then 0 when a.t = p.t then 4 when (a.t, p.t) in (select (t, u) from w) then 1 end as s from bare a, bare p where a.kind = 'a' and p.kind = 'p'),
    shapes as (select distinct name, repo, receiver, caller, args from c),
    met as (select s.*, f.fn_id, f.params, f.class = coalesce(s.receiver, s.caller) as own, len(args) as n, len(params) as m,
        (select count(*) from unnest(range(len(params))) u(i) where not ((last_optional and i = len(params) - 1) or (varies and i = len(params) - 1))) as least, varies from shapes s join f on f.name = s.name and f.repo = s.repo),
    scored as (select met.*, case when n >= least and (varies or n <= m) then case when n = m then 4 else 2 end
        + case when n = 0 then 0 else (select case when count(s) = count(*) then sum(s) end from (select case when met.args[i + 1] = 5 then 0 when m > 0 then (select s from fit where a = met.args[i + 1] and p = met.params[least(i, m - 1) + 1]) end as s from unnest(range(n)) u(i))) end end as score from met),
    narrow as (select *, max(coalesce(own, false)) over (partition by name, repo, receiver, caller, args) as any_own from scored),
    left_over as (select * from narrow where coalesce(own, false) = any_own),
    best as (select name, repo, receiver, caller, args, count(*) as candidates, max(score) as score from left_over group by all),
    won as (select l.name, l.repo, l.receiver, l.caller, l.args, count(*) as n, min(fn_id) as id from left_over l join best b on l.name = b.name and l.repo = b.repo and l.receiver is not distinct from b.receiver and l.caller is not distinct from b.caller and l.args = b.args and l.score = b.score group by all)
    select {C}, case when won.n = 1 then won.id end as fn_id, coalesce(b.candidates, 0)::bigint as candidates, b.score::int as score from c
      left join best b on c.name = b.name and c.repo = b.repo and c.receiver is not distinct from b.receiver and c.caller is not distinct from b.caller and c.args = b.args
      left join won on c.name = won.name and c.repo = won.repo and c.receiver is not distinct from won.receiver and c.caller is not distinct from won.caller and c.args = won.args""",
)
def jn03(t):
    """Class, arity, defaults, variadic parameters and types; the best candidate if it is the only one."""
    listed = lambda names, n, first: F.transform(F.expr(f"filter(sequence(0, 3), i -> i < {n})"), lambda i: F.element_at(F.array(*map(F.lit, names)), ((first + i) % len(names) + 1).cast("int")))
    text = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    p, size = F.col("p_partkey"), F.col("p_size")
    optional = F.transform(F.expr("filter(sequence(0, 3), i -> i < p_size % 4)"), lambda i: (size % 5 == 0) & (i == size % 4 - 1))
    functions = t.part.select(p.alias("fn_id"), text("f", p % 50).alias("name"), text("repo", p % 3).alias("repository_id"), text("C", p % 7).alias("class_name"), listed(TYPES, "p_size % 4", p).alias("parameters"), optional.alias("optional"), (size % 11 == 0).alias("variadic"))
    calls = t.calls_v.select(
        *CALL, F.col("callee").alias("name"), text("repo", F.col("k_supp") % 3).alias("repository_id"), F.when(F.col("k_line") % 3 == 0, text("a.b.C", F.col("k_supp") % 7)).alias("receiver_type"),
        F.when(F.col("k_order") % 9 < 7, text("C", F.col("k_order") % 9)).alias("caller_class"), listed(GIVEN, "k_line % 4", F.col("k_order")).alias("arguments"),
    )
    return op.overloads(calls, functions).select(*CALL, "fn_id", F.col("candidates").cast("long").alias("candidates"), F.col("score").cast("int").alias("score"))


@query(
    "jn35_overrides",
    """with m as (select p_partkey as method, p_partkey // 2 as type, 'f' || (p_partkey % 3) || '(I)V' as descriptor, p_partkey % 7 = 0 as is_static from part), e as (select distinct p_partkey // 2 as type, p_partkey // 6 as parent from part where p_partkey // 2 <> p_partkey // 6)
    select a.method, min(b.method) as overridden from m a join e on a.type = e.type join m b on b.type = e.parent and b.descriptor = a.descriptor where not a.is_static and not b.is_static group by 1 having count(distinct b.method) = 1""",
)
def jn35(t):
    p = F.col("p_partkey")
    methods = t.part.select(p.alias("method"), F.floor(p / 2).alias("type"), F.concat(F.lit("f"), (p % 3).cast("string"), F.lit("(I)V")).alias("descriptor"), (p % 7 == 0).alias("is_static"))
    return op.overrides(methods, t.part.select(F.floor(p / 2).alias("type"), F.floor(p / 6).alias("parent")).filter("type != parent"))
