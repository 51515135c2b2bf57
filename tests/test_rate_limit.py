"""The limit of events in a window over several batches, and how much state it keeps."""

import datetime as dt
import random
from collections import Counter

from lodestone.streaming import events

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_counters_last_over_batches_and_users_share_no_state(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, START + dt.timedelta(minutes=10 * (k // 40) + rng.randrange(40)), k % 3) for k in range(600)]
    for n in range(3):  # a file a batch; windows go over its end
        spark.createDataFrame(rows[200 * n : 200 * n + 200], "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = events.rate_limited(stream, limit=5).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = {r.event_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    seen, expected = Counter(), {}
    for n in range(3):
        for k, ts, user in sorted(rows[200 * n : 200 * n + 200], key=lambda r: (r[1], r[0])):
            seen[window := (user, ts.replace(minute=0))] += 1
            expected[k] = seen[window] <= 5
    assert got == expected
    # one row for each user, however many windows are open
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 3
