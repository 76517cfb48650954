"""Mutual exclusion of syncs: a lease on the shared file system, taken by atomic creation of a file.

A name's leases are numbered files. The highest number is the one that counts: it is held while its owner's heartbeat is
younger than ``ttl`` and it has not been given back. A taker creates the next number; creation fails for all but one.
So an expired lease passes to one taker, and an owner that was away finds a higher number and stops (``check``).
Needs a file system with atomic exclusive creation, as HDFS or a local disk has."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tessera.sources import hadoop


class Conflict(RuntimeError):
    """Another owner holds the lease."""


class Lost(RuntimeError):
    """The lease has passed to another owner."""


class Lease:
    def __init__(self, spark: SparkSession, folder: str, name: str, ttl: float = 300.0, clock: Callable[[], float] = time.time):
        if ttl <= 0:
            raise ValueError("a lease needs a time to live")
        self.spark, self.ttl, self.clock = spark, ttl, clock
        self.folder = f"{folder.rstrip('/')}/{name.encode().hex()}"  # any name makes a folder's name
        self.number, self.owner = 0, uuid.uuid4().hex

    def _file(self, number: int, kind: str = "lease") -> str:
        return f"{self.folder}/{number:012d}.{kind}"

    def _highest(self) -> tuple[int, set[str]]:
        there = set(hadoop.names(self.spark, self.folder))
        return max((int(n.split(".")[0]) for n in there if n.endswith(".lease")), default=0), there

    def _last_sign(self, number: int, there: set[str]) -> float:
        signs = [float(t) for kind in ("lease", "beat") if f"{number:012d}.{kind}" in there and (t := hadoop.read_text(self.spark, self._file(number, kind)).split(" ")[0])]
        return max(signs, default=self.clock())  # a file that is just being written counts as of now

    def holder_until(self) -> float | None:
        """When the present lease runs out, or None where nobody holds one."""
        number, there = self._highest()
        if not number or f"{number:012d}.done" in there:
            return None
        until = self._last_sign(number, there) + self.ttl
        return until if until > self.clock() else None

    def take(self) -> None:
        number, _ = self._highest()
        if self.holder_until() is not None or not hadoop.create_new(self.spark, self._file(number + 1), f"{self.clock()} {self.owner}"):
            raise Conflict(f"{self.folder} is held")
        self.number = number + 1

    def check(self) -> None:
        """Before a write that must not be done twice: fails if the lease has passed on."""
        if not self.number or self._highest()[0] != self.number:
            raise Lost(f"{self.folder} has passed on")

    def beat(self) -> None:
        self.check()
        hadoop.write_text(self.spark, self._file(self.number, "beat"), f"{self.clock()} {self.owner}")

    def give_back(self) -> None:
        if self.number:
            hadoop.create_new(self.spark, self._file(self.number, "done"), "")
            self.number = 0

    @contextmanager
    def held(self) -> Iterator[Lease]:
        """Takes the lease, beats every third of its time to live beside the work, and gives it back."""
        self.take()
        stop = threading.Event()

        def beats():
            while not stop.wait(self.ttl / 3):
                try:
                    self.beat()
                except Lost:
                    return
                except Exception:  # noqa: BLE001  the file system may be away for a while; check() decides before a write
                    continue

        thread = threading.Thread(target=beats, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            stop.set()
            thread.join()
            self.give_back()
