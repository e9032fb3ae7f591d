"""Bounded time and order for work on a session: budgets that fail closed, and a queue that lets people go first."""

from __future__ import annotations

import heapq
import itertools
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import SparkSession


def within(spark: SparkSession, seconds: float, run: Callable[[], Any], otherwise: Any = None) -> Any:
    """What ``run`` gives, or ``otherwise`` if it takes longer or fails: then its Spark jobs are cancelled."""
    group, done = f"budget-{uuid.uuid4().hex}", Future()
    context = spark.sparkContext

    def work() -> None:
        context.setJobGroup(group, "bounded", interruptOnCancel=True)
        try:
            done.set_result(run())
        except BaseException as x:  # noqa: BLE001  handed to the caller's thread
            done.set_exception(x)

    from pyspark import InheritableThread

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    try:
        return done.result(seconds)
    except Exception:  # noqa: BLE001  too late, or failed
        context.cancelJobGroup(group)
        return otherwise


class Queue:
    """One piece of work at a time: interactive before batch, first come first served within each.

    A key that is waiting or running isn't taken twice: who asks again gets the same future.
    """

    ORDER = ("interactive", "batch")

    def __init__(self) -> None:
        self._waiting: list[tuple[int, int, str | None, Callable[[], Any], Future]] = []
        self._known: dict[str, Future] = {}
        self._count, self._lock, self._running = itertools.count(), threading.Lock(), False

    def submit(self, run: Callable[[], Any], kind: str = "interactive", key: str | None = None) -> Future:
        with self._lock:
            if key is not None and key in self._known:
                return self._known[key]
            future: Future = Future()
            if key is not None:
                self._known[key] = future
            heapq.heappush(self._waiting, (self.ORDER.index(kind), next(self._count), key, run, future))
            if not self._running:
                self._running = True
                threading.Thread(target=self._drain, daemon=True).start()
            return future

    def _drain(self) -> None:
        while True:
            with self._lock:
                if not self._waiting:
                    self._running = False
                    return
                _, _, key, run, future = heapq.heappop(self._waiting)
            try:
                future.set_result(run())
            except BaseException as x:  # noqa: BLE001  handed to whoever waits
                future.set_exception(x)
            if key is not None:
                with self._lock:
                    self._known.pop(key, None)
