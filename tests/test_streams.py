"""Streams fed in several batches."""

import tracemalloc
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallymart.operators import audits
from tallymart.streaming import alerts

SCHEMA = "event_id long, chain int, ts timestamp, ok boolean"


def brute(reports, closed):
    out, held = set(), {}
    for event_id, chain, ts, ok in sorted(reports, key=lambda r: (r[2], r[0])):
        if ts >= closed:
            continue
        last = held.setdefault(chain, [])
        last.append(not ok)
        del last[:-10]
        if len(last) >= 3 and 2 * sum(last) >= len(last):
            out.add((event_id, chain, sum(last), len(last)))
    return out


def test_late_reports_take_their_place(spark, tmp_path):
    """Batches whose reports overlap in time: late ones within the watermark count in order of time, later ones not at all."""
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    reports = [(i, i % 2, at(i), i % 3 == 0) for i in range(60)]
    swapped = {3: 12, 14: 22, 20: 29}  # reports that come a batch too late: the batch of a later one
    batches = [[], [], [], []]
    for r in reports:
        batches[swapped.get(r[0], r[0]) // 15].append(r)
    too_late = (1000, 0, at(1), False)
    batches[3].append(too_late)
    got = None
    src, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = alerts.failure_rates(spark.readStream.schema(SCHEMA).parquet(str(src)))
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(out)).collect()}
        seen = [r for b in batches[: n + 1] for r in b if r != too_late]
        newest = max(r[2] for r in seen)
        assert got == brute(seen, newest - timedelta(minutes=10)), n
    assert got == brute(reports, at(49))


def test_prints_follow_changes(spark):
    """Order, cuts, repeats, nulls; a print after a change is that of the changed table."""
    p = lambda rows: audits.multiset_print(spark.createDataFrame(rows, "k int, x string"), "k", content=F.col("x"))
    old = [(1, "a"), (1, "a"), (1, "b"), (2, None), (3, "c")]
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert read(p(old)) == read(p(old[::-1]))
    assert read(p(old)) != read(p([*old[1:], (1, "b")]))
    new = [(1, "a"), (1, "b"), (2, None), (2, "d"), (4, "e")]
    changed = audits.after_change(p(old), p([(2, "d"), (4, "e")]), p([(1, "a"), (3, "c")]), "k")
    assert read(changed) == read(p(new))
    assert read(p([(5, None)]))[0][1:] == read(p([(5, "")]))[0][1:]


def test_waiting_reports_are_packed():
    """A chain's reports, all of a batch before the first watermark, take 17 bytes each in the state and under 100 while it is made."""
    n, batch = 300_000, 10_000
    frame = lambda at: pd.DataFrame({"micros": np.arange(at, at + batch)[::-1], "event_id": np.arange(at, at + batch), "flags": np.ones(batch, np.int8), "ok": False})
    kept = []
    state = SimpleNamespace(exists=False, getCurrentWatermarkMs=lambda: 0, update=kept.append, setTimeoutTimestamp=lambda at: None)
    tracemalloc.start()
    assert sum(map(len, alerts.last_ten_in_order((3,), (frame(at) for at in range(0, n, batch)), state))) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept[0][1]) == 17 * n and peak < 100 * n, peak
    state = SimpleNamespace(exists=True, get=kept[0], getCurrentWatermarkMs=lambda: 200, update=kept.append, setTimeoutTimestamp=lambda at: None)
    out = pd.concat(alerts.last_ten_in_order((3,), iter(()), state))
    assert len(out) == 200_000 - 2 and out["event_id"].iloc[0] == batch - 3 and len(kept[1][1]) == 17 * 100_000


def test_reports_with_gaps(spark, tmp_path):
    """No outcome is no failure, as in SQL; no time never counts; no id comes last of its time."""
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    rows = [(1, 0, at(0), None), (2, 0, at(1), None), (3, 0, None, False), (4, 0, at(2), None), (None, 0, at(3), False), (5, 0, at(3), False), (6, 0, at(4), False), (7, 0, at(60), True)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = alerts.run(alerts.failure_rates(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")))
    assert [tuple(r) for r in got.collect()] == [(6, 0, 3, 6)]
