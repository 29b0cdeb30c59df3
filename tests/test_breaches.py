"""What the keyed spend ceiling holds while calls wait, and calls without a time or an id."""

import pickle
import random
from decimal import Decimal

import pandas as pd

from gapmatch.operators import telemetry as L
from gapmatch.streaming import breaches as B
from gapmatch.streaming import jobs as J
from gapmatch.streaming.breaches import breach_events


class State:
    """A group's state that outlives its batches, with a watermark set by hand."""

    def __init__(self):
        self.get, self.exists, self.watermark = None, False, 0

    def update(self, value):
        self.get, self.exists = value, True

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        pass


def frame(rows):
    """rows: (at, call_id, nano dollars)."""
    df = pd.DataFrame(rows, columns=["at", "call_id", "cost"])
    return df.assign(cost_usd=[Decimal(c).scaleb(-9) for c in df["cost"]])


def test_what_waits_does_not_grow_with_calls_that_cannot_matter():
    rng = random.Random(4)
    dear = [(rng.randrange(10**9), n, rng.randrange(10**7)) for n in range(20_000)]
    free = [(rng.randrange(10**9), n, 0) for n in range(20_000)]
    for rows, least in ((dear, 1), (free, 0)):
        state, run = State(), B._judged(Decimal("0.5"), None)
        assert not list(run(("a",), (frame(rows[lo : lo + 5000]) for lo in range(0, len(rows), 5000)), state))
        assert len(pickle.dumps(state.get)) < 5000
        state.watermark = 10**7
        found = list(run(("a",), iter(()), state))
        total, want = 0, []
        for at, call_id, cost in sorted(rows):
            total += cost
            if total >= 5 * 10**8:
                want = [("a", call_id, at, Decimal(total).scaleb(-9))]
                break
        assert [tuple(r) for f in found for r in f.itertuples(index=False)] == want and len(want) == least


def test_calls_that_wait_come_back_as_they_were(monkeypatch):
    """A ceiling that is far off: all that cost something wait, and are judged as far as the watermark goes, for any batching."""
    monkeypatch.setattr(B, "TAKEN", 70)
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), rng.choice([n, n // 2, B.NO_ID]), rng.randrange(10**6)) for n in range(900)]
    late = sorted(rows)[300:]
    rng.shuffle(late)
    order, found = sorted(rows)[:300] + late, []
    limit = sum(c for _, _, c in rows) * 2 // 3
    for size in (900, 50):
        state, run, events = State(), B._judged(Decimal(limit).scaleb(-9), None), []
        for lo in range(0, 900, size):
            state.watermark = 0 if lo < 300 else sorted(rows)[299][0] // 1000
            events += list(run(("a",), iter([frame(order[lo : lo + size])]), state))
        state.watermark = 10**6
        events += list(run(("a",), iter(()), state))
        found.append([tuple(r) for f in events for r in f.itertuples(index=False)])
    total = 0
    for at, call_id, cost in sorted(rows):
        total += cost
        if total >= limit:
            break
    assert found == [[("a", call_id, at, Decimal(total).scaleb(-9))]] * 2


def test_calls_without_a_time_or_an_id(spark, tmp_path):
    rows = [("a", 1, "10:00", "0.4"), ("a", 2, None, "9.0"), ("a", None, "10:30", "0.6"), ("a", 0, "10:30", "0.6"), ("b", 3, "11:00", None), ("b", 4, "11:01", "1.5")]
    calls = spark.createDataFrame(rows, "installation string, call_id int, at string, c string").selectExpr(
        "installation", "call_id", "cast(concat('2024-01-01 ', at, ':00') as timestamp) created_at", "cast(c as decimal(18,9)) cost_usd")
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    calls.coalesce(1).write.parquet(folder)
    stream = J.file_stream(spark, folder, "*.parquet", calls.schema)
    J.start(breach_events(stream, 1.0, "0 seconds"), J.into(f"{base}/events"), base).awaitTermination()
    later = spark.createDataFrame([("z", 9, "23:00", "0.1")], "installation string, call_id int, at string, c string").selectExpr(
        "installation", "call_id", "cast(concat('2024-01-01 ', at, ':00') as timestamp) created_at", "cast(c as decimal(18,9)) cost_usd")
    later.coalesce(1).write.mode("append").parquet(folder)
    J.start(breach_events(stream, 1.0, "0 seconds"), J.into(f"{base}/events"), base).awaitTermination()
    got = spark.read.schema("installation string, call_id bigint, created_at timestamp, spent_usd decimal(18,9)").parquet(f"{base}/events").collect()
    want = L.first_breaches(L.spend_hours(calls), calls, 1.0).collect()
    assert {(r.installation, r.call_id, r.created_at, r.spent_usd) for r in got} == {(r.installation, r.call_id, r.created_at, r.spent_usd) for r in want}
    assert sorted((r.installation, r.call_id) for r in got) == [("a", None), ("b", 4)]
