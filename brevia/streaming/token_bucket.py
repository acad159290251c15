"""A token bucket for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brevia.streaming import keyed


class TokenBucket(keyed.Machine):
    """`capacity` tokens, refilled at `rate` a second. A refusal sets the time until which requests are refused without
    touching the bucket: that at which it will hold a token."""

    says, width = (("allowed", "boolean"),), 3

    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate = float(capacity), rate

    def start(self):
        return self.capacity, None, None

    def step(self, state, t, ok=True):
        tokens, last, until = state
        if until is not None and t < until:
            return state, (False,)
        if last is not None:
            tokens = min(self.capacity, tokens + (t - last) * self.rate)
        if tokens >= 1:
            return (tokens - 1, t, until), (True,)
        return (tokens, t, t + (1 - tokens) / self.rate), (False,)


def decide(events: DataFrame, key: str, capacity: float, rate: float) -> DataFrame:
    """(key, event_id, allowed)."""
    return keyed.decide(events, key, TokenBucket(capacity, rate))
