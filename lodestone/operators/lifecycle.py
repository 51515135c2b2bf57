"""Identities of findings over snapshots, and the state machines of jobs and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_json


def fingerprint(*parts: Column, version: str = "finding/v2") -> Column:
    """SHA-256 over a canonical JSON array of the version and the parts."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.sha2(F.concat(F.lit(f'["{version}",'), F.concat_ws(",", *quoted), F.lit("]")), 256)


def legacy_fingerprint(*parts: Column) -> Column:
    """16 hex digits over the lower-cased parts, digits as ``#``."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(F.concat_ws(":", *parts), "[0-9]", "#")), 256), 1, 16)


def baseline_states(old: DataFrame, new: DataFrame, closed: DataFrame, key: str, content: str) -> DataFrame:
    """Each key of both snapshots: ``new``, ``regressed`` (closed before), ``unchanged``, ``updated`` or ``absent``."""
    a = old.groupBy(key).agg(F.min(content).alias("_old"))
    b = new.groupBy(key).agg(F.min(content).alias("_new"))
    rows = a.join(b, key, "full").join(closed.select(key, F.lit(True).alias("_closed")).distinct(), key, "left")
    state = (
        F.when(F.col("_new").isNull(), "absent")
        .when(F.col("_closed"), "regressed")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .otherwise("updated")
    )
    return rows.select(key, state.alias("state"))


def upserted(identities: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``identities`` (``key``, ``occurrences``, ``status``) after a snapshot ``seen`` (``key``): counts rise, what was closed reopens, new keys begin at 1."""
    now = seen.groupBy(key).agg(F.lit(1).alias("_now"))
    both = identities.join(now, key, "full")
    status = F.when(F.col("_now").isNotNull() & (F.col("status") == "closed"), "open").otherwise(F.coalesce("status", F.lit("open")))
    return both.select(key, (F.coalesce("occurrences", F.lit(0)) + F.coalesce("_now", F.lit(0))).alias("occurrences"), status.alias("status"))


def claimable(jobs: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    """Jobs that a worker may claim: queued and due, or running with an expired lease; exhausted ones fail.

    ``jobs``: ``job_id``, ``status``, ``due``, ``lease_until``, ``attempts``.  Adds ``next_status``, ``next_attempts``."""
    runnable = ((F.col("status") == "queued") & (F.col("due") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") < now))
    tired = F.col("attempts") >= most_attempts
    return jobs.filter(runnable).select(
        "*", F.when(tired, "failed").otherwise("running").alias("next_status"), (F.col("attempts") + F.when(tired, 0).otherwise(1)).alias("next_attempts")
    )


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int, limit: int, *order: str) -> DataFrame:
    """Events with ``window_start`` and ``admitted``: the first ``limit`` of each key in each fixed window.

    The window's start is part of the key, so a busy key is spread over its windows."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    start = (F.floor(F.timestamp_diff("SECOND", epoch, F.col(ts).cast("timestamp_ntz")) / seconds) * seconds).alias("window_start")
    nth = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, *order))
    return events.select("*", start).withColumn("admitted", nth <= limit)


def alive(beats: DataFrame, worker: str, ts: str, now: Column, seconds: int = 45) -> DataFrame:
    last = beats.groupBy(worker).agg(F.max(ts).alias("last_seen"))
    return last.withColumn("alive", F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(seconds)))


def publishable(scans: DataFrame, project: str, started: str, finished: Column) -> DataFrame:
    """Scans that may become the baseline: none that began later had finished before them."""
    over = Window.partitionBy(project).orderBy(finished.asc(), started).rowsBetween(Window.unboundedPreceding, -1)
    return scans.withColumn("_latest", F.max(started).over(over)).withColumn("publishes", F.col("_latest").isNull() | (F.col("_latest") <= F.col(started))).drop("_latest")


# The fingerprints of other producers that are trusted, the first one that is given before the next.
PREFERRED = ["primaryLocationLineHash", "primaryLocationStartColumnFingerprint"]


def producer_fingerprint(given: Column, own: Column, rule: Column, repository: Column, path: Column, preferred: list[str] | None = None) -> Column:
    """``own`` (what this engine derives) unless a preferred producer's fingerprint is in the map ``given``; then a digest of it within its rule, repository and path.

    Blank fingerprints count as missing; a producer's text never stands by itself, so it can't join findings of other rules or files."""
    found = F.lit(None).cast("string")
    for name in reversed(PREFERRED if preferred is None else preferred):
        value = F.trim(F.element_at(given, F.lit(name)))
        parts = F.to_json(F.array(F.lit("producer/v2"), F.trim(rule), F.trim(F.coalesce(repository, F.lit(""))), path, F.lit(name), value))
        found = F.when(value != "", F.sha2(ascii_json(parts), 256)).otherwise(found)
    return F.coalesce(found, own)


def applicability(present: Column, affected: Column, reachable: Column, verified: Column) -> Column:
    """What a known weakness means here, by evidence that may be missing (null): its component is present, the version is affected, a path reaches it, a run has shown it.

    The first that holds: ``not_affected``, ``exploitable_in_fixture``, ``reachable``, ``version_exposed``, ``needs_evidence``."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~F.coalesce(present, F.lit(True)) | ~F.coalesce(affected, F.lit(True)), "not_affected")
        .when(yes(verified), "exploitable_in_fixture")
        .when(yes(reachable) & yes(affected), "reachable")
        .when(yes(present) & yes(affected), "version_exposed")
        .otherwise("needs_evidence")
    )


def reidentified(known: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Identities after a scan: ``id``, ``status``, ``occurrences``, ``absent``, ``revision``, ``reason``.

    ``known``: ``id``, ``status``, ``occurrences``, ``absent``, ``revision``, ``expires_at`` (of a decision; null: never); ``seen``: ``id``, once for each row found.
    What is seen again counts one more and is absent no longer.  It is open again, under the next revision, where it was absent and decided as ``fixed`` or
    ``false_positive`` (reason ``reappeared``), or where its decision has expired (``expired``, which goes first).  What is not seen stays as it is."""
    new = seen.select("id").distinct().withColumn("_seen", F.lit(True))
    both = known.join(new, "id", "full").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    was_known = F.col("status").isNotNull()
    expired = F.col("_seen") & was_known & F.coalesce(F.col("expires_at") <= now, F.lit(False))
    again = F.col("_seen") & was_known & F.coalesce(F.col("absent"), F.lit(False)) & F.col("status").isin("fixed", "false_positive")
    return both.select(
        "id",
        F.when(expired | again, "open").otherwise(F.coalesce("status", F.lit("open"))).alias("status"),
        (F.coalesce("occurrences", F.lit(0)) + F.col("_seen").cast("long")).alias("occurrences"),
        F.when(F.col("_seen"), False).otherwise(F.col("absent")).alias("absent"),
        (F.coalesce("revision", F.lit(0)) + (expired | again).cast("int")).alias("revision"),
        F.when(expired, "expired").when(again, "reappeared").alias("reason"),
    )


def budget_state(reserved: DataFrame, settled: DataFrame, limit: int) -> DataFrame:
    """``budget``, ``used``, ``held``, ``unknown``, ``open``: what a two-phase counter says after its reservations and settlements.

    ``reserved``: ``call_id``, ``budget``, ``tokens``; ``settled``: ``call_id``, ``used`` (null: the outcome is unknown).  A settled call counts what it used; one that is open or unknown
    keeps its whole reservation.  ``open`` is what may still be reserved of ``limit``; a call that is settled twice or was never reserved is an error."""
    ends = settled.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n"), F.max("used").alias("used"))
    both = reserved.join(ends, "call_id", "full")
    bad = (F.coalesce("_n", F.lit(0)) > 1) | F.col("tokens").isNull()
    rows = both.withColumn("_ok", F.assert_true(~bad, "a call is settled twice or was never reserved")).filter("_ok is null")
    used, held = F.coalesce(F.sum("used"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("used").isNull(), F.col("tokens"))), F.lit(0))
    unknown = F.count_if(F.col("_n").isNotNull() & F.col("used").isNull())
    return rows.groupBy("budget").agg(used.alias("used"), held.alias("held"), unknown.alias("unknown")).withColumn("open", F.greatest(F.lit(limit) - F.col("used") - F.col("held"), F.lit(0)))


def lease_states(beats: DataFrame, now: Column, seconds: dict[str, int]) -> DataFrame:
    """``job_id``, ``kind``, ``worker``, ``fence``, ``state`` (``held`` or ``expired``) of each job by its last lease.

    ``beats``: ``job_id``, ``kind``, ``worker``, ``fence``, ``at``.  A job belongs to the greatest fence; beats under smaller ones came too late and count for nothing.  A lease lasts ``seconds`` of its kind
    from its last beat."""
    last = beats.groupBy("job_id", "kind").agg(F.max(F.struct("fence", "at", "worker")).alias("l"))
    lasts = F.element_at(F.create_map(*(F.lit(x) for pair in seconds.items() for x in pair)), F.col("kind"))
    held = F.unix_timestamp(now) - F.unix_timestamp("l.at") < lasts
    return last.select("job_id", "kind", F.col("l.worker").alias("worker"), F.col("l.fence").alias("fence"), F.when(held, "held").otherwise("expired").alias("state"))
