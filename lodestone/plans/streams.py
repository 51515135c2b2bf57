"""Queries that drain a stream of the events and give what it has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources import sinks
from lodestone.streaming import events as op


def _events(t):
    return op.source(t.spark, f"{t.sf_dir}/events.parquet")


@query(
    "stream_window_counts",
    """with w as (select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2)
    select * from w where window_start + interval 1 hour <= (select max(ts) - interval 1 hour from events)""",
)
def stream_window_counts(t):
    """Windows that the watermark has closed."""
    return op.drained(op.window_counts(_events(t))).withColumn("total", F.round("total", 4))


@query("stream_first_seen", "select event_id, event_type from events")
def stream_first_seen(t):
    return op.drained(op.first_seen(_events(t))).select("event_id", "event_type")


@query("stream_rate_limit", "select event_id, row_number() over (partition by user_id, floor(epoch(ts) / 3600) order by ts, event_id) <= 2 as admitted from events")
def stream_rate_limit(t):
    """SM03 on the stream; the batch query is its twin."""
    return op.drained(op.rate_limited(_events(t)))


@query(
    "stream_leases",
    """with b as (select user_id as job_id, floor(epoch(ts) / 86400)::bigint as fence, 'w' || user_id % 7 as worker, ts as "at", event_id from events), w as (select max(ts) - interval 1 hour as mark from events),
      g as (select *, lag("at") over k is null as first, coalesce("at" >= lag("at") over k + interval 6 hour, false) as gap from b window k as (partition by job_id, fence order by "at", event_id)),
      r as (select *, coalesce(bool_or(gap) over (partition by job_id, fence order by "at", event_id rows between unbounded preceding and current row), false) as lapsed from g),
      l as (select job_id, fence, worker, max("at") filter (where not lapsed) + interval 6 hour as until, max("at") as last, min("at") as start from r group by 1, 2, 3),
      n as (select *, lead(start) over (partition by job_id order by fence) as taken from l)
    select job_id, fence, worker, case when first then 'claimed' when lapsed then 'refused' else 'renewed' end as change, "at" from r
    union all select job_id, fence, worker, 'expired', until from n, w where until <= last or until <= coalesce(taken, mark)""",
)
def stream_leases(t):
    """SM01 and SM02 on the stream: a user's day is a fence, a lease lasts six hours, timers end those that nobody renews."""
    at = F.unix_timestamp("ts")
    beats = _events(t).select(F.col("user_id").alias("job_id"), F.floor(at / 86400).alias("fence"), F.concat(F.lit("w"), (F.col("user_id") % 7).cast("string")).alias("worker"), F.col("ts").alias("at"))
    return op.drained(op.leases(beats, 6 * 3600)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("snk06_graph_lines", """select part, line from (select 0 as part, '{"_kind":"node","fn_id":' || fn_id || ',"name":"' || name || '"}' as line from functions_v union all select 1, '{"_kind":"edge","dst":' || dst || ',"overlay":"' || overlay || '","src":' || src || '}' from edges_v)""")
def snk06(t):
    return sinks.graph_lines(t.functions_v.select("fn_id", "name"), t.edges_v.select("src", "dst", "overlay"))


@query("snk01_sarif", "select scan_id, count(*) as results, count(distinct rule_id) as rules from findings_v group by 1")
def snk01(t):
    """Documents are written and read again; the numbers of results and rules are those of the findings."""
    body = F.from_json("body", "struct<runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string>>>>>")
    docs = sinks.sarif_runs(t.findings_v, "lodestone", "scan_id").select("scan_id", body["runs"][0].alias("run"))
    return docs.select("scan_id", F.size("run.results").cast("long").alias("results"), F.size("run.tool.driver.rules").cast("long").alias("rules"))
