"""Queries on identities over snapshots and on jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import lifecycle as op
from lodestone.plans.registry import query

ID = "rule_id || ':' || file_path || ':' || line_start"
SNAPS = f"""with r as (select {ID} as id, severity, branch from findings_v join scans_v using (scan_id)),
    old as (select id, min(severity) as c from r where branch = 'dev' group by 1), new as (select id, min(severity) as c from r where branch = 'main' group by 1),
    closed as (select distinct {ID} as id from findings_v where confidence < 0.25)"""


def _snapshots(t):
    ident = F.concat_ws(":", "rule_id", "file_path", F.col("line_start").cast("string"))
    rows = t.findings_v.join(t.scans_v.select("scan_id", "branch"), "scan_id").select(ident.alias("id"), "severity", "branch")
    closed = t.findings_v.filter("confidence < 0.25").select(ident.alias("id")).distinct()
    return rows.filter("branch = 'dev'"), rows.filter("branch = 'main'"), closed


@query("lc01_fingerprint", """select scan_id, k_line, k_part, k_supp, k_price, sha256('["finding/v2","' || rule_id || '","' || file_path || '","' || message || '"]') as fingerprint from findings_v""")
def lc01(t):
    return t.findings_v.select("scan_id", "k_line", "k_part", "k_supp", "k_price", op.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("message")).alias("fingerprint"))


@query("lc02_legacy_fingerprint", "select rule_id, file_path, message, substr(sha256(lower(regexp_replace(rule_id || ':' || file_path || ':' || message, '[0-9]', '#', 'g'))), 1, 16) as fingerprint from findings_v group by 1, 2, 3")
def lc02(t):
    rows = t.findings_v.select("rule_id", "file_path", "message").distinct()
    return rows.withColumn("fingerprint", op.legacy_fingerprint(F.col("rule_id"), F.col("file_path"), F.col("message")))


@query("lc03_two_names", "select p_partkey, coalesce(nullif(case when p_partkey % 3 = 0 then p_brand else '' end, ''), nullif(case when p_partkey % 2 = 0 then p_type else '' end, ''), substr(sha256(p_name), 1, 16)) as fingerprint from part")
def lc03(t):
    first = F.nullif(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(""), F.lit(""))
    second = F.nullif(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(""), F.lit(""))
    return t.part.select("p_partkey", F.coalesce(first, second, F.substring(F.sha2("p_name", 256), 1, 16)).alias("fingerprint"))


@query(
    "lc05_baseline",
    SNAPS
    + """ select coalesce(old.id, new.id) as id, case when new.id is null then 'absent' when cl.id is not null then 'regressed' when old.id is null then 'new' when old.c = new.c then 'unchanged' else 'updated' end as state
    from old full join new using (id) left join closed cl on cl.id = coalesce(old.id, new.id)""",
)
def lc05(t):
    return op.baseline_states(*_snapshots(t), "id", "severity")


@query(
    "lc06_identity_upsert",
    SNAPS
    + """, o as (select r.id, count(*) as occurrences, case when cl.id is not null then 'closed' else 'open' end as status from r left join closed cl on cl.id = r.id where branch = 'dev' group by r.id, cl.id)
    select coalesce(o.id, new.id) as id, coalesce(occurrences, 0) + case when new.id is null then 0 else 1 end as occurrences, case when new.id is not null and status = 'closed' then 'open' else coalesce(status, 'open') end as status from o full join new using (id)""",
)
def lc06(t):
    old, new, closed = _snapshots(t)
    known = old.groupBy("id").agg(F.count(F.lit(1)).alias("occurrences")).join(closed.withColumn("c", F.lit("closed")), "id", "left")
    return op.upserted(known.select("id", "occurrences", F.coalesce("c", F.lit("open")).alias("status")), new, "id")


@query("lc08_optimistic_update", "select o_orderkey as scan_id, case when o_orderkey % 4 = o_custkey % 4 then o_custkey % 4 + 1 else o_custkey % 4 end as revision, o_orderkey % 4 = o_custkey % 4 as applied from orders")
def lc08(t):
    """An update applies where its expected version is the current one."""
    current, expected = F.col("o_custkey") % 4, F.col("o_orderkey") % 4
    applied = expected == current
    return t.orders.select(F.col("o_orderkey").alias("scan_id"), F.when(applied, current + 1).otherwise(current).alias("revision"), applied.alias("applied"))


@query("lc09_cache_reuse", "select f.file_path, count(*) as files, count(c.digest) as reused from (select distinct file_path, sha256(message) as digest from findings_v) f left join (select distinct file_path, sha256(message) as digest from findings_v where confidence > 0.9) c using (file_path, digest) group by 1")
def lc09(t):
    digest = F.sha2("message", 256).alias("digest")
    now = t.findings_v.select("file_path", digest).distinct()
    cached = t.findings_v.filter("confidence > 0.9").select("file_path", digest).distinct().withColumn("hit", F.lit(1))
    return now.join(cached, ["file_path", "digest"], "left").groupBy("file_path").agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("reused"))


@query("lc10_evidence_id", "select src, dst, overlay, 'edge:' || substr(sha256(src || chr(1) || dst || chr(1) || overlay), 1, 32) as id from edges_v")
def lc10(t):
    """As evidence ids, but joined by U+0001: DuckDB has no string with NUL; the function's own separator has a unit test."""
    joined = F.sha2(F.concat_ws("\x01", F.col("src").cast("string"), F.col("dst").cast("string"), "overlay"), 256)
    return t.edges_v.select("src", "dst", "overlay", F.concat(F.lit("edge:"), F.substring(joined, 1, 32)).alias("id"))


@query("lc13_scoped_absence", f"with s as (select distinct {ID} as id from findings_v where rule_id = 'R005'), n as (select distinct {ID} as id from findings_v where rule_id = 'R005' and disposition = 'blocking') select id from s where id not in (select id from n)")
def lc13(t):
    ident = F.concat_ws(":", "rule_id", "file_path", F.col("line_start").cast("string")).alias("id")
    scope = t.findings_v.filter("rule_id = 'R005'")
    return scope.select(ident).distinct().join(scope.filter("disposition = 'blocking'").select(ident).distinct(), "id", "left_anti")


JOBS = "select event_id as job_id, case when event_type in ('view', 'click') then 'queued' else 'running' end as status, ts as due, ts + interval 2 minute as lease_until, user_id % 5 as attempts from events"


@query("sm01_claims", f"with j as ({JOBS}), n as (select max(ts) - interval 1 hour as now from events) select job_id, case when attempts >= 3 then 'failed' else 'running' end as next_status, attempts + case when attempts >= 3 then 0 else 1 end as next_attempts from j, n where (status = 'queued' and due <= now) or (status = 'running' and lease_until < now)")
def sm01(t):
    kind = F.when(F.col("event_type").isin("view", "click"), "queued").otherwise("running")
    jobs = t.events.select(F.col("event_id").alias("job_id"), kind.alias("status"), F.col("ts").alias("due"), (F.col("ts") + F.expr("interval 2 minutes")).alias("lease_until"), (F.col("user_id") % 5).alias("attempts"))
    now = t.events.agg(F.max("ts") - F.expr("interval 1 hour")).scalar()
    return op.claimable(jobs, now).select("job_id", "next_status", "next_attempts")


@query("sm03_rate_limit", "select event_id, (floor(epoch(ts) / 3600) * 3600)::bigint as window_start, row_number() over (partition by user_id, floor(epoch(ts) / 3600) order by ts, event_id) <= 2 as admitted from events")
def sm03(t):
    return op.rate_limited(t.events, "user_id", "ts", 3600, 2, "event_id").select("event_id", "window_start", "admitted")


@query("sm04_liveness", "select user_id, max(ts) as last_seen, max(ts) >= (select max(ts) from events) - interval 86400 second as alive from events group by 1")
def sm04(t):
    return op.alive(t.events, "user_id", "ts", t.events.agg(F.max("ts")).scalar(), 86400)


@query(
    "sm05_late_publication",
    "with s as (select *, created_at + to_days((scan_id % 400)::int) as finished from scans_v), p as (select *, max(created_at) over (partition by project_id order by finished, created_at, scan_id rows between unbounded preceding and 1 preceding) as latest from s) select scan_id, latest is null or latest <= created_at as publishes from p",
)
def sm05(t):
    """A slow scan must not replace the baseline of one that began later."""
    scans = t.scans_v.withColumn("finished", F.expr("created_at + make_dt_interval(CAST(scan_id % 400 AS int))"))
    over = Window.partitionBy("project_id").orderBy("finished", "created_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("created_at").over(over)
    return scans.withColumn("latest", latest).select("scan_id", (F.col("latest").isNull() | (F.col("latest") <= F.col("created_at"))).alias("publishes"))


@query("sm06_triage_expiry", "select scan_id, case when status = 'completed' and created_at + interval 365 day < (select max(created_at) from scans_v) then 'reopened' else status end as status from scans_v")
def sm06(t):
    last = t.scans_v.agg(F.max("created_at")).scalar()
    expired = (F.col("status") == "completed") & (F.col("created_at") + F.expr("interval 365 days") < last)
    return t.scans_v.select("scan_id", F.when(expired, "reopened").otherwise(F.col("status")).alias("status"))


@query("sm08_sums", "select conv_id, sum(n_chars) filter (role = 'assistant')::bigint as settled, coalesce(sum(n_chars) filter (role = 'user'), 0)::bigint as reserved, count(*) filter (n_chars > 500) as unknown from turns_v group by 1")
def sm08(t):
    return t.turns_v.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "assistant", F.col("n_chars"))).alias("settled"),
        F.coalesce(F.sum(F.when(F.col("role") == "user", F.col("n_chars"))), F.lit(0)).alias("reserved"),
        F.count_if(F.col("n_chars") > 500).alias("unknown"),
    )


@query("sm09_call_replay", "select conv_id, turn from turns_v t where role = 'user' and not exists (select 1 from turns_v a where a.conv_id = t.conv_id and a.turn = t.turn + 1 and a.role = 'assistant')")
def sm09(t):
    """Calls that were dispatched and not settled; they are never sent again."""
    settled = t.turns_v.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return t.turns_v.filter("role = 'user'").join(settled, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("sm10_retention", "select scan_id, case when created_at < timestamp '1994-01-01' then null else status end as status from scans_v where created_at >= timestamp '1993-01-01'")
def sm10(t):
    """Old rows go; of those less old the state is cleared."""
    kept = t.scans_v.filter(F.col("created_at") >= F.lit("1993-01-01").cast("timestamp"))
    return kept.select("scan_id", F.when(F.col("created_at") >= F.lit("1994-01-01").cast("timestamp"), F.col("status")).alias("status"))


@query("ag24_status_rollup", "select project_id, case when bool_or(status = 'running') then 'waiting' when bool_or(status = 'partial') then 'partial' else 'completed' end as status, count(*) as runs from scans_v group by 1")
def ag24(t):
    state = F.when(F.bool_or(F.col("status") == "running"), "waiting").when(F.bool_or(F.col("status") == "partial"), "partial").otherwise("completed")
    return t.scans_v.groupBy("project_id").agg(state.alias("status"), F.count(F.lit(1)).alias("runs"))


@query("ag26_run_list", "select s.scan_id, count(f.scan_id) as findings, count(distinct f.rule_id) as rules, count(distinct f.file_path) as files from (select * from scans_v order by created_at desc, scan_id desc limit 100) s left join findings_v f using (scan_id) group by 1")
def ag26(t):
    """The newest hundred are the feature."""
    newest = t.scans_v.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(100).select("scan_id")
    rows = newest.join(t.findings_v.select("scan_id", "rule_id", "file_path"), "scan_id", "left")
    return rows.groupBy("scan_id").agg(F.count("rule_id").alias("findings"), F.count_distinct("rule_id").alias("rules"), F.count_distinct("file_path").alias("files"))


@query(
    "sm08_token_budget",
    """with r as (select conv_id * 1000 + turn as id, conv_id, n_chars as tokens from turns_v where role = 'user'), s as (select conv_id * 1000 + turn - 1 as id, case when n_chars % 5 > 0 then n_chars // 2 end as used from turns_v where role = 'assistant' and conv_id * 1000 + turn - 1 in (select id from r))
    select conv_id as budget, coalesce(sum(used), 0)::bigint as used, coalesce(sum(tokens) filter (used is null), 0)::bigint as held, count(*) filter (s.id is not null and used is null) as unknown, greatest(2000 - coalesce(sum(used), 0) - coalesce(sum(tokens) filter (used is null), 0), 0)::bigint as open
    from r left join s using (id) group by 1""",
)
def sm08_budget(t):
    """A user's turn reserves, the answer settles; one answer in five has an unknown outcome."""
    call = F.col("conv_id") * 1000 + F.col("turn")
    reserved = t.turns_v.filter("role = 'user'").select(call.alias("call_id"), F.col("conv_id").alias("budget"), F.col("n_chars").alias("tokens"))
    answers = t.turns_v.filter("role = 'assistant'").select((call - 1).alias("call_id"), F.when(F.col("n_chars") % 5 > 0, F.floor(F.col("n_chars") / 2)).alias("used"))
    return op.budget_state(reserved, answers.join(reserved.select("call_id"), "call_id", "left_semi"), 2000)


@query(
    "sm02_leases",
    """with b as (select user_id as job_id, case user_id % 3 when 0 then 'scan' when 1 then 'review' else 'rules' end as kind, 'w' || (event_id % 4) as worker, event_id // 50 as fence, ts from events),
    l as (select job_id, kind, arg_max(worker, (fence, ts, worker)) as worker, max(fence) as fence, max(ts) as beat from (select *, max(fence) over (partition by job_id) as most from b) where fence = most group by 1, 2)
    select job_id, kind, worker, fence::bigint as fence, case when epoch((select max(ts) from events)) - floor(epoch(beat)) < case kind when 'rules' then 60000 else 120000 end then 'held' else 'expired' end as state from l""",
)
def sm02_leases(t):
    """The last fence holds a job, until its time without a beat is over; kinds of jobs have times of their own."""
    kind = F.when(F.col("user_id") % 3 == 0, "scan").when(F.col("user_id") % 3 == 1, "review").otherwise("rules")
    beats = t.events.select(F.col("user_id").alias("job_id"), kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 4).cast("string")).alias("worker"), F.floor(F.col("event_id") / 50).alias("fence"), F.col("ts").cast("timestamp").alias("at"))
    now = t.events.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return op.lease_states(beats, now, {"scan": 120_000, "review": 120_000, "rules": 60_000})
