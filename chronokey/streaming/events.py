"""Streaming forms of the limiter and the per-second counters, on the batch functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiter import decide


def acquire_stream(calls: DataFrame, capacity: int, rate_milli: int, cost: int) -> DataFrame:
    """Limiter decisions over a stream of (key, seq, now_ms): a bucket is kept for each key, calls of
    one batch go in order of seq. A state that would have refilled is the same as none, so a
    timeout could drop it without changing answers."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        p = pd.concat(list(parts)).sort_values("seq")
        rows = []
        for seq, now in zip(p["seq"], p["now_ms"], strict=True):
            answer, held = decide(held, int(now), capacity, rate_milli, cost)
            rows.append((key[0], int(seq), *answer))
        if held is not None:
            state.update(held)
        yield pd.DataFrame(rows, columns=["key", "seq", "allowed", "remaining", "retry_ms", "reset_ms"])

    return calls.groupBy("key").applyInPandasWithState(run, "key string, seq long, allowed boolean, remaining long, retry_ms long, reset_ms long", "tokens_ut long, last_ms long", "append", GroupStateTimeout.NoTimeout)


def per_second_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Counts by second and key class of (ts, kind), late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 second"), "kind").count()
