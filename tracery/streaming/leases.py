"""The lease state machine as a stream: claims, heartbeats and completions by task, kept across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

STATE = "status string, token string, until double, attempts int"
OUTPUT = "task_id string, event_id long, action string, accepted boolean, status string, attempts int"


def decide(state: tuple, action: str, token: str | None, at: float, lease: float, most: int) -> tuple[tuple, bool]:
    """(new state, accepted) of one event; a state is (status, token, until, attempts).

    A lease that has run out is given back, or fails the task after its last attempt; what an expired or another
    lease's holder sends is rejected.
    """
    status, held, until, attempts = state
    if status == "running" and at > until:
        status, held = ("failed" if attempts >= most else "queued"), None
    if action == "enqueue":
        return ((status, held, until, attempts), False) if status else (("queued", None, 0.0, 0), True)
    if action == "claim" and status == "queued":
        return ("running", token, at + lease, attempts + 1), True
    if status == "running" and token == held:
        if action == "heartbeat":
            return (status, held, at + lease, attempts), True
        if action == "complete":
            return ("completed", None, until, attempts), True
        if action == "fail":
            return ("failed" if attempts >= most else "queued", None, until, attempts), True
    return (status, held, until, attempts), False


def fold(key: tuple, rows: pd.DataFrame, state: tuple, lease: float, most: int) -> tuple[pd.DataFrame, tuple]:
    """The events of one task in time order: a verdict each, and the state after them."""
    out = []
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        state, good = decide(state, r.action, r.token, r.at, lease, most)
        out.append((key[0], r.event_id, r.action, good, state[0], state[3]))
    return pd.DataFrame(out, columns=["task_id", "event_id", "action", "accepted", "status", "attempts"]), state


def lease_verdicts(events: DataFrame, lease: float = 300.0, most: int = 3) -> DataFrame:
    """A verdict for each event (task_id, event_id, action, token, at); works on streams and on tables.

    Only one row of state is kept a task, so memory follows open tasks, not events.
    """
    empty = (None, None, 0.0, 0)
    if not events.isStreaming:
        return events.groupBy("task_id").applyInPandas(lambda key, rows: fold(key, rows, empty, lease, most)[0], OUTPUT)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, now = fold(key, pd.concat(list(batches)), state.get if state.exists else empty, lease, most)
        state.update(now)
        yield out

    return events.groupBy("task_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
