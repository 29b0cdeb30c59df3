"""The spend ceiling as keyed stream state: one event per installation, at the exact call.

Calls are judged in the order of time and id, as far as the watermark says that no earlier call can still come; later ones
wait in the state. An installation's state is its running total and the calls that wait, as one compressed value. A call
that costs nothing never waits, as it cannot be the one that reaches the ceiling, nor do those behind the call that
reaches it among those known so far: costs are not below zero, so what still comes can only move that call forward. When the
total reaches the ceiling, one event goes out, the waiting calls are let go and later calls are ignored. With ``forget``,
an installation that is silent for so long is let go altogether.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as K
from ..operators.telemetry import MONEY

NANO = 9  #: decimals of MONEY
NO_ID = -(1 << 63)
TAKEN = 1 << 18  #: calls that a task takes in before it lets go of those that no longer matter
EVENT = f"installation string, call_id bigint, at bigint, spent_usd {MONEY}"
STATE = f"spent {MONEY}, over boolean, last bigint, waiting binary"


def _packed(calls: np.ndarray) -> bytes:
    """Sorted calls, a row each of times, ids and costs, as one value: times as steps."""
    steps = calls.copy()
    steps[0, 1:] = np.diff(calls[0])
    return zlib.compress(steps.tobytes(), 1)


def _unpacked(waiting: bytes) -> np.ndarray:
    calls = np.frombuffer(zlib.decompress(waiting), np.int64).reshape(3, -1).copy()
    np.cumsum(calls[0], out=calls[0])
    return calls


def _first(calls: np.ndarray, spent: int, ceiling: int) -> np.ndarray:
    """Calls by time and id, up to the one at which the total reaches the ceiling."""
    calls = calls[:, np.lexsort(calls[::-1])]
    return calls[:, : np.searchsorted(spent + np.cumsum(calls[2]), ceiling) + 1]


def _judged(ceiling: Decimal, forget_us: int | None):
    limit = math.ceil(ceiling.scaleb(NANO))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, over, last, waiting = state.get if state.exists else (Decimal(0), False, 0, _packed(np.zeros((3, 0), np.int64)))
        spent = int(spent.scaleb(NANO))
        held = [_unpacked(waiting)]
        for part in batches:
            if part.empty:  # on a time-out
                continue
            last = max(last, int(part["at"].max()))
            if not over and limit > 0:
                calls = part[["at", "call_id", "cost"]].to_numpy(np.int64).T
                held.append(calls[:, calls[2] != 0])
                if sum(h.shape[1] for h in held[1:]) > TAKEN:
                    held = [_first(np.concatenate(held, axis=1), spent, limit)]
        upto = state.getCurrentWatermarkMs() * 1000
        calls = _first(np.concatenate(held, axis=1), spent, limit)
        ready = int(np.searchsorted(calls[0], upto))
        event = None
        if ready:
            spent += int(calls[2, :ready].sum())
            if spent >= limit:  # reached by the last of them, as none behind it is held
                over, event = True, (key[0], int(calls[1, ready - 1]), int(calls[0, ready - 1]), Decimal(spent).scaleb(-NANO))
        calls = calls[:, :0] if over else calls[:, ready:]
        if forget_us is not None and not calls.size and last + forget_us < upto:
            state.remove()
        else:
            state.update((Decimal(spent).scaleb(-NANO), over, last, _packed(calls)))
            # Called again when the first waiting call can be judged, or when silence has lasted.
            again = int(calls[0, 0]) if calls.size else last + forget_us if forget_us is not None else None
            if again is not None:
                state.setTimeoutTimestamp(max(again, upto) // 1000 + 1)
        if event:
            yield pd.DataFrame([event], columns=["installation", "call_id", "at", "spent_usd"])

    return run


def breach_events(
    calls: DataFrame, ceiling: float = K.SPEND_CEILING_USD, lateness: str = "1 hour", forget: timedelta | None = None
) -> DataFrame:
    """(installation, call_id, created_at, spent_usd) of a stream of calls (installation, call_id, created_at, cost_usd).

    The events are those of ``telemetry.first_breaches`` over the same calls, for any batching, as long as no call is
    more than ``lateness`` behind; calls of the last ``lateness`` are judged when later ones come. A ceiling of 0 is
    never reached. A call without a time counts as little as it does there; one without an id comes first at its time.
    """
    cost = F.coalesce((F.col("cost_usd").cast(MONEY) * 10**NANO).cast("bigint"), F.lit(0))
    timed = calls.filter("created_at is not null").withWatermark("created_at", lateness).select(
        F.col("installation").cast("string").alias("installation"), F.coalesce(F.col("call_id").cast("bigint"), F.lit(NO_ID)).alias("call_id"),
        "created_at", F.unix_micros("created_at").alias("at"), cost.alias("cost"))
    if forget is None:  # else a call without cost breaks the silence; the watermark counts it either way
        timed = timed.filter("cost <> 0")
    span = None if forget is None else forget // timedelta(microseconds=1)
    events = timed.groupBy("installation").applyInPandasWithState(
        _judged(Decimal(str(ceiling)), span), EVENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return events.select("installation", F.nullif("call_id", F.lit(NO_ID)).alias("call_id"), F.timestamp_micros("at").alias("created_at"), "spent_usd")
