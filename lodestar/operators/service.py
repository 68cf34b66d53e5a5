"""Searches one at a time, as a server answers them: a cache, a few workers and a bounded queue before them."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Row

from lodestar.operators.index import Index
from lodestar.operators.search import search


@dataclass(frozen=True)
class EngineConfig:
    """Workers, waiting requests beyond them, cached answers, and the search plan."""

    workers: int = 4
    queue: int = 64
    cache: int = 200
    algorithm: str = "wand"


class QueueFull(RuntimeError):
    """All workers are busy and the queue is full; the request was not taken."""


@dataclass(frozen=True)
class Answer:
    hits: list[Row]
    cached: bool
    queue_wait_us: int


class SearchService:
    """``query`` looks into the cache, else searches the index and keeps the answer; the least recently used one goes.

    The driver holds at most ``cache`` answers of k rows. Jobs of several workers share the session's executors.
    """

    def __init__(self, index: Index, config: EngineConfig | None = None):
        self.index, self.config = index, config or EngineConfig()
        self._spark = index.postings.sparkSession
        self._pool = ThreadPoolExecutor(self.config.workers, thread_name_prefix="search")
        self._slots = threading.BoundedSemaphore(self.config.workers + self.config.queue)
        self._answers: OrderedDict[tuple[str, int], list[Row]] = OrderedDict()
        self._lock = threading.Lock()

    def query(self, text: str, k: int = 10) -> Future[Answer]:
        """The answer to come; QueueFull at once if the queue is full."""
        if not self._slots.acquire(blocking=False):
            raise QueueFull("queue full")
        try:
            answer = self._pool.submit(self._run, text, k, time.perf_counter())
        except RuntimeError:
            self._slots.release()
            raise
        answer.add_done_callback(lambda _: self._slots.release())
        return answer

    def _run(self, text: str, k: int, came: float) -> Answer:
        waited = int((time.perf_counter() - came) * 1e6)
        with self._lock:
            hits = self._answers.get((text, k))
            if hits is not None:
                self._answers.move_to_end((text, k))
                return Answer(hits, True, waited)
        hits = self._search(text, k)
        with self._lock:
            self._answers[text, k] = hits
            self._answers.move_to_end((text, k))
            while len(self._answers) > self.config.cache:
                self._answers.popitem(last=False)
        return Answer(hits, False, waited)

    def _search(self, text: str, k: int) -> list[Row]:
        q = self._spark.createDataFrame([(0, text)], "qid long, text string")
        return search(q, self.index, k, self.config.algorithm).drop("qid").orderBy("rank").collect()

    def close(self) -> None:
        self._pool.shutdown()
