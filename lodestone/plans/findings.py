"""Queries over findings: filters, caps, ranks, roll-ups, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import findings as op
from lodestone.operators.digests import joined_sha256
from lodestone.plans.registry import query

RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"
BLOCK = "case when disposition = 'blocking' then 0 else 1 end"
ROW = "scan_id, k_line, k_part, k_supp, k_price"


@query(
    "s0_triage_report",
    f"""with kept as (select *, {RANK} as sev_rank from findings_v where {RANK} <= 2 and confidence >= 0.3),
    dedup as (select * from (select *, row_number() over (partition by rule_id, file_path, line_start, line_end
      order by {BLOCK}, confidence desc, {ROW}) as rn from kept) where rn = 1),
    capped as (select *, row_number() over (partition by file_path order by {BLOCK}, sev_rank, confidence desc, line_start, rule_id, line_end, {ROW}) as pos from dedup)
    select severity, sum(case when pos <= 50 then 1 else 0 end)::bigint as kept, sum(case when pos > 50 then 1 else 0 end)::bigint as omitted
    from capped group by severity""",
)
def s0_triage_report(t):
    """FLT01, WN01, WN02, AG01: what a triage run keeps, and what its caps leave out."""
    dedup = op.occurrences(op.above_threshold(t.findings_v))
    order = [op.blocking_first(), op.ordinal(F.col("severity"), op.SEVERITIES), F.desc("confidence"), "line_start", "rule_id", "line_end", *op.ROW]
    kept = op.first_of(dedup, ["file_path"], order, 50).groupBy("severity").agg(F.count(F.lit(1)).alias("kept"))
    total = dedup.groupBy("severity").agg(F.count(F.lit(1)).alias("total"))
    n = F.coalesce("kept", F.lit(0))
    return total.join(kept, "severity", "left").select("severity", n.alias("kept"), (F.col("total") - n).alias("omitted"))


@query("flt01_threshold", f"select {ROW}, severity, confidence from findings_v where {RANK} <= 2 and confidence >= 0.3 and not contains(file_path, 'm13')")
def flt01(t):
    return op.above_threshold(t.findings_v, generated=["m13"]).select(*op.ROW, "severity", "confidence")


@query("flt02_conjunctive", f"select {ROW} from findings_v where severity = 'high' and disposition = 'blocking' and evidence_state = 'candidate' and rule_id = 'R005'")
def flt02(t):
    wanted = {"severity": "high", "disposition": "blocking", "evidence_state": "candidate", "rule_id": "R005"}
    rows = t.findings_v
    for name, value in wanted.items():
        rows = rows.filter(F.col(name) == value)
    return rows.select(*op.ROW)


@query("flt03_language_suffix", f"select {ROW}, file_path from findings_v where ends_with(file_path, '.py') or ends_with(file_path, '.go')")
def flt03(t):
    return t.findings_v.filter(F.col("file_path").endswith(".py") | F.col("file_path").endswith(".go")).select(*op.ROW, "file_path")


@query("flt04_search", f"select {ROW} from findings_v where (contains(lower(message), 'line 12') or contains(lower(file_path), 'line 12') or contains(lower(rule_id), 'line 12')) and ends_with(file_path, '.ts')")
def flt04(t):
    hit = [F.contains(F.lower(c), F.lit("line 12")) for c in ("message", "file_path", "rule_id")]
    return t.findings_v.filter((hit[0] | hit[1] | hit[2]) & F.col("file_path").endswith(".ts")).select(*op.ROW)


@query(
    "flt05_row_security",
    "select scan_id, project_id, status from scans_v s where exists (select 1 from members_v m where m.project_id = s.project_id and user_id = 7 and role in ('triager', 'maintainer', 'admin'))",
)
def flt05(t):
    return op.visible(t.scans_v, t.members_v, 7, "triager").select("scan_id", "project_id", "status")


@query("flt07_by_names", "select file_path, regexp_matches(file_path, '(^|/)(m1|m7)[^/]*$') as is_test, count(*) as n from findings_v group by 1, 2")
def flt07(t):
    return t.findings_v.withColumn("is_test", F.col("file_path").rlike("(^|/)(m1|m7)[^/]*$")).groupBy("file_path", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("flt08_has_findings", "select scan_id, status from scans_v where scan_id in (select scan_id from findings_v where severity = 'critical')")
def flt08(t):
    return t.scans_v.join(t.findings_v.filter("severity = 'critical'").select("scan_id").distinct(), "scan_id", "left_semi").select("scan_id", "status")


@query("flt13_overdue", f"select {ROW}, created_at from findings_v where created_at < timestamp '1997-01-01' and evidence_state in ('candidate') and severity not in ('low')")
def flt13(t):
    return t.findings_v.filter((F.col("created_at") < F.lit("1997-01-01").cast("timestamp")) & F.col("evidence_state").isin("candidate") & ~F.col("severity").isin("low")).select(*op.ROW, "created_at")


@query("flt16_symbol_search", "select fn_id, qualified_name from functions_v where contains(name, 'f1') or contains(qualified_name, 'm7.') order by qualified_name, fn_id limit 10")
def flt16(t):
    """The first ten are the feature: one page of a search."""
    return t.functions_v.filter(F.col("name").contains("f1") | F.col("qualified_name").contains("m7.")).orderBy("qualified_name", "fn_id").limit(10).select("fn_id", "qualified_name")


@query(
    "flt18_confidence_decay",
    f"""select {ROW}, round(confidence * case when k_supp % 2 = 0 then 0.5 else 1 end * case when k_part % 3 = 0 then 0.3 else 1 end * case when k_line = 1 then 0.1 else 1 end, 6) as confidence
    from findings_v where confidence >= 0.3""",
)
def flt18(t):
    """Defences multiply; they decay what the threshold has already let through."""
    scale = F.lit(1.0)
    for when, factor in ((F.col("k_supp") % 2 == 0, 0.5), (F.col("k_part") % 3 == 0, 0.3), (F.col("k_line") == 1, 0.1)):
        scale = scale * F.when(when, factor).otherwise(1.0)
    return t.findings_v.filter("confidence >= 0.3").select(*op.ROW, F.round(F.col("confidence") * scale, 6).alias("confidence"))


@query(
    "flt19_two_codes",
    """select scan_id, case when any_value(status) = 'partial' then 3 when bool_or(disposition = 'blocking' and severity in ('critical', 'high')) then 1 else 0 end as exit_code
    from scans_v join findings_v using (scan_id) group by scan_id""",
)
def flt19(t):
    gate = F.bool_or((F.col("disposition") == "blocking") & F.col("severity").isin("critical", "high"))
    rows = t.findings_v.groupBy("scan_id").agg(gate.alias("blocked")).join(t.scans_v, "scan_id")
    return rows.select("scan_id", F.when(F.col("status") == "partial", 3).when(F.col("blocked"), 1).otherwise(0).alias("exit_code"))


@query("flt20_absence_admission", "select scan_id from scans_v where status = 'completed' and branch = 'main' and scan_id not in (select scan_id from findings_v where evidence_state = 'candidate' and confidence < 0.25)")
def flt20(t):
    gaps = t.findings_v.filter("evidence_state = 'candidate' and confidence < 0.25").select("scan_id").distinct()
    return t.scans_v.filter("status = 'completed' and branch = 'main'").join(gaps, "scan_id", "left_anti").select("scan_id")


@query("flt21_review_split", f"select {ROW}, confidence < 0.7 as review, case when confidence < 0.7 then (row_number() over (partition by file_path, confidence < 0.7 order by {ROW}) - 1) // 25 end as batch from findings_v")
def flt21(t):
    """FLT21, FLT22: what is under the threshold goes to review, in batches of 25 of one file."""
    rows = t.findings_v.withColumn("review", F.col("confidence") < 0.7)
    placed = op.numbered(rows, ["file_path", "review"], "scan_id", 4096, op.ROW, "nth")
    return placed.select(*op.ROW, "review", F.when(F.col("review"), F.floor((F.col("nth") - 1) / 25)).alias("batch"))


@query(
    "wn01_occurrences",
    f"""select {ROW} from (select *, row_number() over (partition by rule_id, file_path, line_start, line_end order by {BLOCK}, confidence desc, {ROW}) as rn from findings_v) where rn = 1""",
)
def wn01(t):
    return op.occurrences(t.findings_v).select(*op.ROW)


@query(
    "wn02_file_cap",
    f"""select {ROW}, file_path, greatest(total - 20, 0) as omitted from (select *, count(*) over (partition by file_path) as total,
    row_number() over (partition by file_path order by {BLOCK}, {RANK}, confidence desc, line_start, rule_id, {ROW}) as pos from findings_v) where pos <= 20""",
)
def wn02(t):
    order = [op.blocking_first(), op.ordinal(F.col("severity"), op.SEVERITIES), F.desc("confidence"), "line_start", "rule_id", *op.ROW]
    return op.capped(t.findings_v, ["file_path"], order, 20).select(*op.ROW, "file_path", "omitted")


@query(
    "wn03_rule_cap",
    f"""select {ROW}, rule_id, greatest(total - 10, 0) as omitted from (select *, count(*) over (partition by rule_id) as total,
    row_number() over (partition by rule_id order by confidence desc, {ROW}) as pos from findings_v) where pos <= 10""",
)
def wn03(t):
    return op.capped(t.findings_v, ["rule_id"], [F.desc("confidence"), *op.ROW], 10).select(*op.ROW, "rule_id", "omitted")


@query("wn04_rule_file_cap", f"""select {ROW} from (select *, row_number() over (partition by rule_id, file_path order by line_start, {ROW}) as pos from findings_v) where pos <= case when ends_with(file_path, '.py') then 2 else 5 end""")
def wn04(t):
    """Five for call patterns, two for source patterns; Python files stand for the latter."""
    kept = op.first_of(t.findings_v.withColumn("cap", F.when(F.col("file_path").endswith(".py"), 2).otherwise(5)), ["rule_id", "file_path"], ["line_start", *op.ROW], 5)
    nth = F.row_number().over(Window.partitionBy("rule_id", "file_path").orderBy("line_start", *op.ROW))
    return kept.withColumn("nth", nth).filter("nth <= cap").select(*op.ROW)


@query("wn09_latest_scan", "select project_id, arg_max(scan_id, (created_at, scan_id)) as scan_id from scans_v group by project_id")
def wn09(t):
    return t.scans_v.groupBy("project_id").agg(F.max(F.struct("created_at", "scan_id")).alias("last")).select("project_id", "last.scan_id")


@query("ag01_severity_counts", "select s.severity, count(f.scan_id) as n from (values ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) left join findings_v f using (severity) group by 1")
def ag01(t):
    return op.counts_over(t.findings_v, "severity", [*op.SEVERITIES, "info"])


@query("ag02_state_counts", "select evidence_state, count(*) as n from findings_v group by 1")
def ag02(t):
    return t.findings_v.groupBy("evidence_state").agg(F.count(F.lit(1)).alias("n"))


@query("ag03_disposition_counts", "select d.disposition, count(f.scan_id) as n from (values ('blocking'), ('advisory'), ('suppressed')) d(disposition) left join findings_v f using (disposition) group by 1")
def ag03(t):
    return op.counts_over(t.findings_v, "disposition", ["blocking", "advisory", "suppressed"])


@query("ag04_top_rules", "select rule_id, severity, count(*) as n from findings_v group by 1, 2 order by n desc, rule_id, severity limit 15")
def ag04(t):
    """The first fifteen are the feature."""
    return t.findings_v.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id", "severity").limit(15)


@query("ag05_min_label", "select rule_id, min(message) as message, count(*) as n from findings_v group by 1")
def ag05(t):
    return t.findings_v.groupBy("rule_id").agg(F.min("message").alias("message"), F.count(F.lit(1)).alias("n"))


@query("ag06_languages", "select distinct scan_id, regexp_extract(file_path, '[.]([a-z]+)$', 1) as language from findings_v")
def ag06(t):
    return t.findings_v.select("scan_id", F.regexp_extract("file_path", "[.]([a-z]+)$", 1).alias("language")).distinct()


@query(
    "ag07_relation_counts",
    """with n as (select scan_id, count(*) as n from findings_v group by 1),
    last as (select project_id, count(*) as scans, arg_max(scan_id, (created_at, scan_id)) as scan_id from scans_v group by 1)
    select p.project_id, coalesce(scans, 0) as scans, last.scan_id as latest, coalesce(n, 0) as findings
    from projects_v p left join last using (project_id) left join n on n.scan_id = last.scan_id""",
)
def ag07(t):
    last = t.scans_v.groupBy("project_id").agg(F.count(F.lit(1)).alias("scans"), F.max(F.struct("created_at", "scan_id"))["scan_id"].alias("latest"))
    n = t.findings_v.groupBy(F.col("scan_id").alias("latest")).agg(F.count(F.lit(1)).alias("findings"))
    rows = t.projects_v.select("project_id").join(last, "project_id", "left").join(n, "latest", "left")
    return rows.select("project_id", F.coalesce("scans", F.lit(0)).alias("scans"), "latest", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("ag08_severity_pivot", "select scan_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in op.SEVERITIES) + " from findings_v group by 1")
def ag08(t):
    return t.findings_v.groupBy("scan_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in op.SEVERITIES))


@query("ag09_conditional", "select file_path, sum(n)::bigint as n, coalesce(sum(case when severity in ('critical', 'high') then n end), 0)::bigint as severe from (select file_path, severity, count(*) as n from findings_v group by 1, 2) group by 1")
def ag09(t):
    two = t.findings_v.groupBy("file_path", "severity").agg(F.count(F.lit(1)).alias("n"))
    return two.groupBy("file_path").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("severity").isin("critical", "high"), F.col("n"))), F.lit(0)).alias("severe"))


@query(
    "ag10_gaps",
    f"""select rule_id as code, evidence_state as stage, count(*) as affected, arg_min(message, ({ROW})) as message, 'partial' as status from findings_v where confidence < 0.4 group by 1, 2""",
)
def ag10(t):
    first = F.min(F.struct(*op.ROW, "message"))["message"]
    return t.findings_v.filter("confidence < 0.4").groupBy(F.col("rule_id").alias("code"), F.col("evidence_state").alias("stage")).agg(F.count(F.lit(1)).alias("affected"), first.alias("message")).withColumn("status", F.lit("partial"))


@query("ag17_file_highlight", f"select file_path, min({RANK}) as worst, count(*) as n from findings_v group by 1")
def ag17(t):
    return t.findings_v.groupBy("file_path").agg(F.min(op.ordinal(F.col("severity"), op.SEVERITIES)).alias("worst"), F.count(F.lit(1)).alias("n"))


@query("ag20_snapshot_digest", "select scan_id, sha256(string_agg(line, '' order by line)) as digest from (select distinct scan_id, file_path || chr(1) || sha256(rule_id || message) || chr(10) as line from findings_v) group by 1")
def ag20(t):
    """A digest over the sorted lines of a scan, one line a distinct (path, content)."""
    line = F.concat("file_path", F.lit("\x01"), F.sha2(F.concat("rule_id", "message"), 256), F.lit("\n"))
    lines = t.findings_v.select("scan_id", line.alias("line")).distinct()
    return joined_sha256(lines, "scan_id", ["line"], F.col("line"))


@query(
    "ag23_merged_summary",
    """select project_id, sum(n)::bigint as findings, bool_or(status = 'partial') as truncated, string_agg(distinct branch, ',' order by branch) as branches
    from scans_v join (select scan_id, count(*) as n from findings_v group by 1) using (scan_id) group by 1""",
)
def ag23(t):
    n = t.findings_v.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    rows = t.scans_v.join(n, "scan_id")
    return rows.groupBy("project_id").agg(F.sum("n").alias("findings"), F.bool_or(F.col("status") == "partial").alias("truncated"), F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branches"))


@query("so01_first_hundred", f"select {ROW}, row_number() over (order by {RANK}, confidence desc, {ROW}) as place from findings_v where confidence > 0.9 and disposition = 'blocking' qualify place <= 100")
def so01(t):
    """The first hundred blocking ones of high confidence."""
    first = t.findings_v.filter("confidence > 0.9 and disposition = 'blocking'").orderBy(op.ordinal(F.col("severity"), op.SEVERITIES), F.desc("confidence"), *op.ROW).limit(100)
    place = F.row_number().over(Window.orderBy(op.ordinal(F.col("severity"), op.SEVERITIES), F.desc("confidence"), *op.ROW))
    return first.select(*op.ROW, place.alias("place"))


@query("so01_final_order", f"select {ROW}, row_number() over (order by {RANK}, confidence desc, {ROW}) as place from findings_v")
def so01_all(t):
    """Every finding's place: rows are numbered by ranges of scans within a (severity, confidence), whose counts are summed up."""
    return op.ordered(t.findings_v.withColumn("_rank", op.ordinal(F.col("severity"), op.SEVERITIES)), ["_rank"], "confidence", 1 << 16, "place").select(*op.ROW, "place")


@query("so02_page", f"select {ROW}, (select count(*) from findings_v) as total from findings_v order by {ROW} limit 25 offset 50")
def so02(t):
    return op.page(t.findings_v.select(*op.ROW), op.ROW, 3, 25)


@query("so04_keyset", "select scan_id, status, true as more from scans_v where scan_id > 100 order by scan_id limit 20")
def so04(t):
    return op.after(t.scans_v.select("scan_id", "status"), "scan_id", 100, 20)


@query("so05_lexicographic", "select severity, row_number() over (order by severity) as place from (select distinct severity from findings_v)")
def so05(t):
    """Severities as strings: not the order of their ranks."""
    return t.findings_v.select("severity").distinct().withColumn("place", F.row_number().over(Window.orderBy("severity")))


@query("so06_siblings", f"select * from (select {ROW}, rule_id, count(*) over (partition by rule_id, file_path) as total, row_number() over (partition by rule_id, file_path order by {ROW}) as nth from findings_v) where nth <= 3")
def so06(t):
    keys = ["rule_id", "file_path"]
    totals = t.findings_v.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    first = op.first_of(t.findings_v, keys, op.ROW, 3).join(totals, keys)
    return first.select(*op.ROW, "rule_id", "total", F.row_number().over(Window.partitionBy(*keys).orderBy(*op.ROW)).alias("nth"))


@query("so07_event_tail", "select event_id, event_type from events where event_id > 500 order by event_id limit 100")
def so07(t):
    return t.events.filter("event_id > 500").orderBy("event_id").limit(100).select("event_id", "event_type")


@query(
    "flt19_gate",
    """select scan_id, case when any_value(status) = 'running' then 2 when any_value(status) = 'partial' then 3 when coalesce(bool_or(disposition = 'blocking' and severity in ('critical', 'high')), false) then 1 else 0 end as exit_code
    from scans_v left join findings_v using (scan_id) group by scan_id""",
)
def flt19_codes(t):
    """2 for a scan that did not end, 3 for one that covers a part, 1 for blocking findings, 0 else; scans without findings too."""
    return op.gate(t.scans_v, t.findings_v, ["critical", "high"])


@query(
    "flt22_batches",
    f"""with r as (select {ROW}, file_path, length(message) as cost, (row_number() over (partition by file_path order by {ROW}) - 1) // 25 as batch from findings_v where confidence < 0.7),
    b as (select file_path, batch, sum(cost) as cost from r group by 1, 2), u as (select *, sum(cost) over (partition by file_path order by batch) as upto from b) select file_path, batch, cost::bigint as cost, upto <= 3000 as run from u""",
)
def flt22(t):
    """Batches of 25 of a file; once they cost more than the budget, this one and the later ones of the file are left."""
    rows = t.findings_v.filter("confidence < 0.7").withColumn("cost", F.length("message"))
    return op.budgeted_batches(rows, "file_path", op.ROW, 25, "cost", 3000)


@query("so03_other_keys", f"select {ROW}, (select count(*) from findings_v) as total from findings_v order by file_path, line_start desc, {ROW} limit 40 offset 80")
def so03(t):
    rows = t.findings_v.select(*op.ROW, "file_path", "line_start")
    return op.page(rows, ["file_path", F.desc("line_start"), *op.ROW], 3, 40).select(*op.ROW, "total")
