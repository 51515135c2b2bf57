"""Leases and baselines over batches, against the batch operators."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from lodestone.operators.lifecycle import lease_states
from lodestone.operators.storage import shared_dir
from lodestone.streaming import events as op

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, batches, schema, flow):
    """What a stream gives for files that arrive one after the other, each in a run of its own, and the rows of state after each."""
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(op._PROVIDER)
    spark.conf.set(op._PROVIDER, op._WITH_TIMERS)
    states = []
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = flow(spark.readStream.schema(schema).parquet(f"{root}/in"))
            q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start(f"{root}/out")
            q.awaitTermination()
            states.append(max((o["numRowsTotal"] for p in q.recentProgress[-1:] for o in p["stateOperators"]), default=0))
        return spark.read.schema(stream.schema).parquet(f"{root}/out"), states
    finally:
        spark.conf.set(op._PROVIDER, before)


BEATS = "job_id long, fence long, worker string, at timestamp"


def test_three_batches_with_late_and_repeated_beats(spark):
    batches = [
        [(1, 5, "a", at(0)), (1, 5, "a", at(60)), (1, 4, "b", at(70)), (2, 1, "a", at(10))],
        [(1, 5, "a", at(100)), (1, 5, "a", at(100)), (2, 2, "b", at(100)), (2, 1, "a", at(110)), (3, 1, "c", at(4000))],
        [(1, 5, "a", at(3992)), (1, 6, "d", at(3995)), (3, 1, "c", at(4050)), (1, 7, "e", at(50)), (4, 1, "c", at(9000))],
    ]
    found, _ = run(spark, batches, BEATS, lambda s: op.leases(s, 120, late="10 seconds"))
    got = sorted((r.job_id, r.at, r.fence, r.change) for r in found.collect())
    want = [
        (1, 0, 5, "claimed"), (1, 60, 5, "renewed"), (1, 70, 4, "refused"), (1, 100, 5, "renewed"), (1, 100, 5, "renewed"), (1, 220, 5, "expired"), (1, 3992, 5, "refused"), (1, 3995, 6, "claimed"), (1, 4115, 6, "expired"),
        (2, 10, 1, "claimed"), (2, 100, 2, "claimed"), (2, 110, 1, "refused"), (2, 220, 2, "expired"), (3, 4000, 1, "claimed"), (3, 4050, 1, "renewed"), (3, 4170, 1, "expired"), (4, 9000, 1, "claimed"),
    ]
    assert got == [(j, at(s), f, c) for j, s, f, c in want]  # the beat at 50 came behind the watermark


def test_last_states_equal_the_batch_operator_and_state_goes(spark):
    rng = random.Random(5)
    rows = sorted((rng.randrange(9), 100 * k + rng.randrange(90)) for k in range(60) for _ in range(3))
    # a fence for each claim: a worker beats a few times and is followed by the next
    beats = [(j, s // 700, f"w{s // 700}", at(s)) for j, s in rows]
    beats.sort(key=lambda b: b[3])
    end = [(99, 1, "z", at(200_000))]
    batches = [beats[:60], beats[60:120], beats[120:], end, [(99, 1, "z", at(400_000))]]
    found, states = run(spark, batches, BEATS, lambda s: op.leases(s, 800, keep=1000, late="1 second"))
    last = found.filter("job_id <> 99").groupBy("job_id").agg(F.max(F.struct("fence", "at", "change")).alias("l"))
    seen = {(r.job_id, r.l.fence, r.l.change) for r in last.collect()}
    table = spark.createDataFrame([(j, "scan", w, f, a) for j, f, w, a in beats], "job_id long, kind string, worker string, fence long, at timestamp")
    batch = {(r.job_id, r.fence, r.state) for r in lease_states(table, F.lit(at(200_000)), {"scan": 800}).collect()}
    assert seen == batch and {s for _, _, s in batch} == {"expired"}
    assert max(states) <= 3 * 10 and states[-1] <= 3  # a lease and its timer for each job that is left


def test_a_slow_scan_never_becomes_the_baseline(spark):
    rng = random.Random(3)
    scans = [(p, 100 * p + k, at(b), at(b + rng.randrange(5000))) for p in range(6) for k, b in enumerate(rng.sample(range(9000), 15))]
    scans.sort(key=lambda r: (r[3], r[2], r[1]))
    schema = "project_id long, scan_id long, created_at timestamp, finished timestamp"
    found, states = run(spark, [scans[:30], scans[30:60], scans[60:]], schema, op.baselines)
    newest, want = {}, {}
    for p, s, began, _ in scans:
        want[s] = began >= newest.get(p, began)
        newest[p] = max(began, newest.get(p, began))
    assert {r.scan_id: r.publishes for r in found.collect()} == want and not all(want.values())
    assert states[-1] == 6
