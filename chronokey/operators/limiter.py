"""Token buckets in exact integer arithmetic, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
SHAPE = "key string, seq long, allowed boolean, remaining long, retry_ms long, reset_ms long, tokens_ut long, last_ms long"


def decide(state: tuple[int, int] | None, now: int, capacity: int, rate_milli: int, cost: int, consume: bool = True):
    """((allowed, remaining, retry_ms, reset_ms), state): micro-tokens and the clock they refer to.

    A bucket refills ``rate_milli`` micro-tokens a millisecond. A clock that runs backwards
    refills nothing; a stored clock further ahead than a full refill takes is set back.
    """
    cap = capacity * MICRO
    whole = -(-cap // rate_milli)
    tokens, last, fixed = (cap, now, False) if state is None else (min(max(state[0], 0), cap), state[1], False)
    if last - now > whole:
        last, fixed = now, True
    if now > last:
        tokens = cap if now - last >= whole else min(cap, tokens + (now - last) * rate_milli)
        last = now
    allowed = tokens >= cost * MICRO
    if allowed and consume:
        tokens -= cost * MICRO
    wait = -1 if allowed else -(-(cost * MICRO - tokens) // rate_milli)
    answer = (allowed, tokens // MICRO, wait, -(-(cap - tokens) // rate_milli))
    return answer, ((tokens, last) if consume and (allowed or fixed) else state)


def acquire(calls: DataFrame, capacity: int, rate_milli: int, cost: int, consume: bool = True) -> DataFrame:
    """Decisions for ``calls`` (key, seq, now_ms, and peek if some of them only ask): the recurrence isn't
    associative, so a key's calls run in one task, in order of seq, batch by batch; only the bucket is
    held between them."""
    calls = calls if "peek" in calls.columns else calls.withColumn("peek", F.lit(False))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for p in parts:
            rows = []
            for k, seq, now, peek in zip(p["key"], p["seq"], p["now_ms"], p["peek"], strict=True):
                if k != key:
                    key, state = k, None
                answer, state = decide(state, now, capacity, rate_milli, cost, consume and not peek)
                rows.append((k, seq, *answer, *(state or (None, None))))
            yield pd.DataFrame(rows, columns=["key", "seq", "allowed", "remaining", "retry_ms", "reset_ms", "tokens_ut", "last_ms"]).astype({"tokens_ut": "Int64", "last_ms": "Int64"})

    return calls.select("key", "seq", "now_ms", "peek").repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, SHAPE)
