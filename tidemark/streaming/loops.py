"""A service as a loop: one process at a time, a tick again and again until it is told to stop."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from tidemark.sources.vtable import Files


class Taken(RuntimeError):
    """Another process runs this service."""


class Loop:
    """Runs tick() at once while it does something, else every interval seconds. A claim in a folder of its own
    keeps a second process away; a claim whose holder has not renewed it within stale seconds may be taken.
    Errors end the loop and free the claim: what a tick has not finished is begun again by the next one."""

    def __init__(self, files: Files, claim: str, tick: Callable[[], object], *, interval: float = 60.0, stale: float = 300.0, clock: Callable[[], float] = time.time):
        self.files, self.claim, self.tick = files, claim, tick
        self.interval, self.stale, self.clock, self.stop = interval, stale, clock, threading.Event()
        self.name = uuid.uuid4().hex

    def _take(self) -> None:
        mark = json.dumps({"name": self.name, "at": self.clock()})
        if self.files.publish(self.claim, mark):
            return
        held = json.loads(self.files.read(self.claim))
        if held["name"] != self.name and self.clock() - held["at"] <= self.stale:
            raise Taken(f"{self.claim} is held since {held['at']}")
        self.files.delete(self.claim)
        if not self.files.publish(self.claim, mark):
            raise Taken(f"{self.claim} was taken in between")

    def run(self) -> int:
        """The number of ticks until the loop was stopped."""
        self._take()
        ticks = 0
        try:
            while not self.stop.is_set():
                busy = self.tick()
                ticks += 1
                self._take()
                if not busy:
                    self.stop.wait(self.interval)
        finally:
            self.files.delete(self.claim)
        return ticks
