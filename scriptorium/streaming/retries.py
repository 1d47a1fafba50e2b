"""The retry rule as a stream of outcomes, with the state of each item in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Waits before the retries, and what each settling outcome makes of an item.
DELAYS_MS = (5 * 60_000, 30 * 60_000, 2 * 3_600_000)
SETTLED = {"ok": "done", "config": "failed", "hopeless": "skipped"}


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Outcomes of an item in their order: the first that settles it ends it, a fault is retried three times.

    Of a batch only the outcomes that can still matter are held: the first that settles and the first four faults.
    """
    status, retries, wait = state.get if state.exists else ("queued", 0, 0)
    end, faults = None, []
    for frame in frames:
        for at, outcome in zip(frame["at"], frame["outcome"], strict=True):
            if outcome in SETTLED:
                end = min(end, (at, outcome)) if end else (at, outcome)
        faults = sorted([*faults, *frame.loc[~frame["outcome"].isin(list(SETTLED)), "at"].nsmallest(4)])[:4]
    if status == "queued":
        for at in faults:
            if end and end[0] < at:
                break
            if retries == len(DELAYS_MS):
                status, wait = "failed", 0
                break
            wait, retries = DELAYS_MS[retries], retries + 1
        if status == "queued" and end:
            status, wait = SETTLED[end[1]], wait if end[1] == "config" else 0
    state.update((status, retries, wait))
    yield pd.DataFrame({"id": [key[0]], "status": [status], "retries": [retries], "wait_ms": [wait]})


def advance(outcomes: DataFrame) -> DataFrame:
    """id, status, retries, wait_ms after each batch, from a stream of (id, at, outcome).

    Outcomes: ``ok`` settles as done, ``config`` as failed, ``hopeless`` as skipped; any other one, null too, is a
    fault.  A settled item takes no further outcomes.  Late outcomes count in the batch that brings them.
    """
    kind = "id long, status string, retries long, wait_ms long"
    held = "status string, retries long, wait_ms long"
    return outcomes.select("id", "at", "outcome").groupBy("id").applyInPandasWithState(_advance, kind, held, "update", GroupStateTimeout.NoTimeout)
