"""Days processed side by side, with progress, cancellation and a choice of what a failure does."""

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class CancellationToken:
    def __init__(self):
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()


@dataclass
class Progress:
    done: int
    total: int
    elapsed: float

    @property
    def percent(self) -> float:
        return 100.0 * self.done / self.total if self.total else 100.0

    @property
    def eta(self) -> float | None:
        return self.elapsed / self.done * (self.total - self.done) if self.done else None


@dataclass
class Outcome:
    results: dict = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    elapsed: float = 0.0

    def by_day(self) -> list[tuple]:
        return sorted(self.results.items())


def run(spark: SparkSession, days: list, work: Callable, fail_fast: bool = True, parallel: int = 4, progress: Callable[[Progress], None] | None = None, token: CancellationToken | None = None) -> Outcome:
    """work(spark, day) of every day in Spark jobs side by side.

    fail_fast stops the days that haven't begun and cancels the jobs under way; else errors are collected."""
    began, out, token = time.time(), Outcome(), token or CancellationToken()
    tag = f"tickforge-batch-{id(out)}"

    def one(day):
        if token.cancelled:
            raise InterruptedError("cancelled")
        spark.addTag(tag)
        return work(spark, day)

    with ThreadPoolExecutor(parallel) as pool:
        futures = {pool.submit(one, d): d for d in days}
        for n, f in enumerate(as_completed(futures), 1):
            try:
                out.results[futures[f]] = f.result()
            except Exception as e:  # a day's failure is a result of the batch
                out.errors[futures[f]] = f"{type(e).__name__}: {e}"
                if fail_fast and not token.cancelled:
                    token.cancel()
                    spark.interruptTag(tag)
            if progress:
                progress(Progress(n, len(futures), time.time() - began))
    out.elapsed = time.time() - began
    return out
