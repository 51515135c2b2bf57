"""Queries on detection quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import metrics as op
from lodestone.plans.registry import query

COUNTS = """count(*) filter (positive and detected) as tp, count(*) filter (not positive and detected) as fp,
    count(*) filter (positive and not detected) as fn, count(*) filter (not positive and not detected) as tn"""
SCORES = """round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6)::double as f1,
    round((tp + tn)::double / nullif(tp + fp + fn + tn, 0), 6) as accuracy, round(fp::double / nullif(fp + tn, 0), 6) as fpr,
    round((tp::double / nullif(tp + fn, 0) + tn::double / nullif(tn + fp, 0)) / 2, 6) as balanced,
    round((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) as mcc,
    round(greatest((p + z2 / (2 * n) - sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * z) / (1 + z2 / n), 0), 6) as recall_low,
    round(least((p + z2 / (2 * n) + sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * z) / (1 + z2 / n), 1), 6) as recall_high"""
Z = "select *, nullif(tp + fn, 0)::double as n, tp / nullif(tp + fn, 0)::double as p, 1.959963984540054::double as z, (1.959963984540054::double * 1.959963984540054::double) as z2"


@query("ag11_confusion", f"select lang, {COUNTS} from labelled_v group by 1")
def ag11(t):
    return op.confusion(t.labelled_v, ["lang"], F.col("positive"), F.col("detected"))


@query("ag12_case_metrics", f"with c as (select lang, {COUNTS} from labelled_v group by 1), w as ({Z} from c) select lang, tp, fp, fn, tn, {SCORES} from w")
def ag12(t):
    return op.scores(op.confusion(t.labelled_v, ["lang"], F.col("positive"), F.col("detected")))


@query("ag13_two_channels", f"with r as (select *, unnest(case when toxic = 1 then ['all', 'toxic'] else ['all', 'clean'] end) as channel from labelled_v) select channel, {COUNTS} from r group by 1")
def ag13(t):
    channels = F.when(F.col("toxic") == 1, F.array(F.lit("all"), F.lit("toxic"))).otherwise(F.array(F.lit("all"), F.lit("clean")))
    return op.confusion(t.labelled_v.withColumn("channel", F.explode(channels)), ["channel"], F.col("positive"), F.col("detected"))


@query("ag14_pairs", "select case when detected = positive then 'right' else 'wrong' end as before, case when (toxic = 1) = positive then 'right' else 'wrong' end as after, count(*) as n from labelled_v group by 1, 2")
def ag14(t):
    state = lambda c: F.when(c == F.col("positive"), "right").otherwise("wrong")
    return t.labelled_v.groupBy(state(F.col("detected")).alias("before"), state(F.col("toxic") == 1).alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("ag15_distribution", "select event_type, min(value) as least, round(quantile_cont(value, 0.5), 6) as median, quantile_disc(value, 0.95) as p95, max(value) as most from events group by 1")
def ag15(t):
    return op.distribution(t.events, ["event_type"], "value")


@query("ag18_baseline_histogram", "select case when detected and positive then 'unchanged' when detected then 'new' when positive then 'absent' else 'none' end as state, count(*) as n from labelled_v group by 1")
def ag18(t):
    state = F.when(F.col("detected") & F.col("positive"), "unchanged").when(F.col("detected"), "new").when(F.col("positive"), "absent").otherwise("none")
    return t.labelled_v.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("jn20_case_outcomes", "select lang, case when l.doc_id is null then 'unlabelled' when quality = 1 and n_chars > 1500 then 'hit' when quality = 1 then 'missed' else 'negative' end as reason, count(*) as n from documents d left join labels l using (doc_id) group by 1, 2")
def jn20(t):
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "unlabelled").when((F.col("quality") == 1) & (F.col("n_chars") > 1500), "hit").when(F.col("quality") == 1, "missed").otherwise("negative")
    return rows.groupBy("lang", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("jn21_paired_reports", "select a.doc_id, a.detected as before, b.toxic = 1 as after from labelled_v a join labelled_v b using (doc_id) where a.detected <> (b.toxic = 1)")
def jn21(t):
    before = t.labelled_v.select("doc_id", F.col("detected").alias("before"))
    after = t.labelled_v.select("doc_id", (F.col("toxic") == 1).alias("after"))
    return before.join(after, "doc_id").filter("before != after")


@query("fn21_wilson", "with w as (select role, count(*) as k, (select count(*) from turns_v) as m from turns_v group by 1), z as (select *, m::double as n, k / m::double as p, 1.959963984540054::double as z, (1.959963984540054::double * 1.959963984540054::double) as z2 from w) select role, round((p + z2 / (2 * n) - sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * z) / (1 + z2 / n), 6) as low from z")
def fn21(t):
    k = t.turns_v.groupBy("role").agg(F.count(F.lit(1)).alias("k"))
    total = t.turns_v.agg(F.count(F.lit(1))).scalar()
    return k.withColumn("m", total).select("role", F.round(fn.wilson(F.col("k"), F.col("m"))[0], 6).alias("low"))


@query(
    "ag13_channels",
    f"""with r as (select *, unnest(case when toxic = 1 then ['all', 'blocking'] else ['all', 'advisory'] end) as channel, doc_id % 5 + 20 as cwe from labelled_v) select channel, null::bigint as cwe, {COUNTS} from r group by channel union all select channel, cwe, {COUNTS} from r group by channel, cwe""",
)
def ag13_cwe(t):
    """Every channel as a whole and by weakness."""
    channels = F.array(F.lit("all"), F.when(F.col("toxic") == 1, "blocking").otherwise("advisory"))
    rows = t.labelled_v.select("*", F.explode(channels).alias("channel"), (F.col("doc_id") % 5 + 20).alias("cwe"))
    return op.by_channel(rows, "channel", "cwe", F.col("positive"), F.col("detected"))


@query(
    "ag14_transitions",
    """with o as (select case when detected then case when positive then 'TP' else 'FP' end else case when positive then 'FN' else 'TN' end end as a, case when toxic = 1 then case when positive then 'TP' else 'FP' end else case when positive then 'FN' else 'TN' end end as b from labelled_v)
    select a || '->' || b as transition, count(*) as n, case when a = b then 'same' when b in ('TP', 'TN') then 'improvement' else 'regression' end as kind from o group by a, b""",
)
def ag14_kinds(t):
    """What became of every case between two reports, and which way it went."""
    return op.transitions(t.labelled_v, F.col("positive"), F.col("detected"), F.col("toxic") == 1)
