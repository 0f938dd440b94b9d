from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

from larkspur.operators import workflow


def plain(rows, limit, seconds):
    out, opened, place, last = {}, None, 0, object()
    for user, event, ts in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[2] or datetime.min, r[1])):
        if user != last:
            last, opened, place = user, None, 0
        if ts is None:
            out[event] = (user, 1, True, None)
            continue
        s = (ts - datetime(1970, 1, 1)) / timedelta(seconds=1)
        if opened is None or s >= opened + seconds:
            opened, place = s, 0
        place += 1
        wait = max(1, math.ceil(opened + seconds - s)) if place > limit else None
        out[event] = (user, place, place <= limit, wait)
    return out


def test_rate_windows_against_a_plain_loop(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    users = [1, 1, 1, 2, 3, None]  # one client has half of all events
    rows = [(rng.choice(users), i, start + timedelta(seconds=rng.randrange(4000) / 2)) for i in range(3000)]
    rows += [(4, 5000, start), (4, 5001, start + timedelta(seconds=60)), (4, 5002, start + timedelta(seconds=60))]
    rows += [(1, 6000, None), (7, 6001, None), (7, 6002, None)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)  # clients and windows reach over batches
    try:
        got = workflow.rate_windows(events, 5, 60).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["event_id"]: (r["user_id"], r["place"], r["allowed"], r["retry_after"]) for r in got} == plain(rows, 5, 60)
    assert len(got) == len(rows)
    assert workflow.rate_windows(events.where("false"), 5, 60).collect() == []
