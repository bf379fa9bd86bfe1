"""Time rules as small state machines: one step per event, shared by batch and stream."""

from __future__ import annotations

from capsule import fixed


class SlidingLimit:
    """Accept an event unless `limit` accepted ones lie inside the window before it. Refused events leave no trace."""

    state = "accepted array<bigint>"
    out = "accepted boolean"

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window * 1_000_000
        self.idle = window

    def start(self):
        return ([],)

    def step(self, state, ts, ok):
        recent = [t for t in state[0] if t > ts - self.window]
        if len(recent) >= self.limit:
            return (recent,), False
        return (recent + [ts],), True


class Lockout:
    """Lock after a number of failures in a row; a success resets, attempts while locked change nothing."""

    state = "failures int, locked_until bigint"
    out = "outcome string"

    def __init__(self, after: int = fixed.LOCK_AFTER, seconds: int = fixed.LOCK_SECONDS):
        self.after, self.seconds = after, seconds * 1_000_000
        self.idle = None

    def start(self):
        return 0, 0

    def step(self, state, ts, ok):
        failures, locked = state
        if locked > ts:
            return state, "locked"
        if ok:
            return (0, 0), "ok"
        failures += 1
        if failures >= self.after:
            return (0, ts + self.seconds), "locked"
        return (failures, locked), "invalid"


class FetchCache:
    """An event is a fetch when nothing fresh is cached; only a successful fetch fills the cache."""

    state = "fetched_at bigint"
    out = "fetched boolean"

    def __init__(self, ttl: int = fixed.CACHE_TTL_SECONDS):
        self.ttl = ttl * 1_000_000
        self.idle = ttl

    def start(self):
        return (None,)

    def step(self, state, ts, ok):
        if state[0] is not None and ts - state[0] < self.ttl:
            return state, False
        return ((ts,) if ok else state), True


class RetryGate:
    """A failed run suppresses new runs for a while; a success never does."""

    state = "failed_at bigint"
    out = "started boolean"

    def __init__(self, seconds: int = fixed.ERROR_RETRY_SECONDS):
        self.seconds = seconds * 1_000_000
        self.idle = seconds

    def start(self):
        return (None,)

    def step(self, state, ts, ok):
        if state[0] is not None and ts - state[0] < self.seconds:
            return state, False
        return ((None,) if ok else (ts,)), True
