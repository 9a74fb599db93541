"""A watchdog: a query whose trigger works on for too long without ending a batch is stopped."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery


class Stalled(RuntimeError):
    """An active trigger ended no batch within the limit."""


def stalled(active: bool, batch: int, since: tuple[int, float] | None, now: float, limit: float) -> tuple[bool, tuple[int, float] | None]:
    """(whether the limit is passed, the mark to keep): the mark is the batch and when it was first seen
    active; an idle query or a new batch starts afresh."""
    if not active:
        return False, None
    if since is None or since[0] != batch:
        return False, (batch, now)
    return now - since[1] > limit, since


def watch(query: StreamingQuery, limit: float, *, poll: float = 1.0, clock: Callable[[], float] = time.monotonic) -> None:
    """Waits for the query's end; raises Stalled (and stops the query on a thread of its own) if it stalls."""
    mark = None
    while query.isActive:
        last = query.lastProgress
        over, mark = stalled(query.status["isTriggerActive"], last["batchId"] if last else -1, mark, clock(), limit)
        if over:
            threading.Thread(target=query.stop, daemon=True).start()
            raise Stalled(f"no batch in {limit} s")
        query.awaitTermination(poll)
    query.awaitTermination()
