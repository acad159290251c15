"""A circuit breaker for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from brevia.streaming import keyed


class CircuitBreaker(keyed.Machine):
    """After `failures` in a row the circuit is open and calls are refused; once `wait` seconds have passed one is tried
    (half_open): its success closes the circuit, its failure opens it anew."""

    says, width = (("state", "string"), ("allowed", "boolean")), 2

    def __init__(self, failures: int = 3, wait: float = 60.0):
        self.failures, self.wait = failures, wait

    def start(self):
        return 0.0, None

    def step(self, state, t, ok):
        failed, since = state
        now = "closed" if since is None else "half_open" if t - since >= self.wait else "open"
        if now == "open":
            return state, (now, False)
        failed = 0.0 if ok else failed + 1
        opens = not ok and (now == "half_open" or failed >= self.failures)
        return (failed, t if opens else None), (now, True)


def decide(events: DataFrame, key: str, ok: Column, failures: int = 3, wait: float = 60.0) -> DataFrame:
    """(key, event_id, state, allowed)."""
    return keyed.decide(events, key, CircuitBreaker(failures, wait), ok)
