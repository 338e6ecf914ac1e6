"""Work that is done again and again on the driver: rescans of a repository, and answers within a time."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame

from ..operators.indexing import changed
from ..sources.store import written

#: Least pause between rescans, how many times the last one's length, seconds of a hook.
LEAST_PAUSE_S, PAUSE_FACTOR, HOOK_S = 2.0, 10.0, 1.5


def pause(last_s: float) -> float:
    """Seconds to wait after a scan that took ``last_s``."""
    return max(LEAST_PAUSE_S, PAUSE_FACTOR * last_s)


class Rescanner:
    """Scans (path, cid) and applies only what differs from the last scan applied.  A scan or an
    application that fails leaves the state degraded; the next one then applies whatever it finds."""

    def __init__(self, scan: Callable[[], DataFrame], apply: Callable[[DataFrame], None], clock: Callable[[], float] = time.monotonic):
        self.scan, self.apply, self.clock = scan, apply, clock
        self.before: DataFrame | None = None
        self.degraded, self.error = False, ""

    def step(self) -> tuple[bool, float]:
        """(whether something was applied, seconds to the next step)."""
        began, applied = self.clock(), False
        try:
            now = written(self.scan().select("path", "cid"), "scan")
            if self.degraded or self.before is None or changed(self.before, now):
                self.apply(now)
                applied = True
            self.before, self.degraded, self.error = now, False, ""
        except Exception as e:  # the next step tries again
            self.degraded, self.error = True, str(e)
        return applied, pause(self.clock() - began)

    def run(self, steps: int, sleep: Callable[[float], None] = time.sleep) -> int:
        """That many steps with their pauses; how many applied something."""
        count = 0
        for i in range(steps):
            applied, wait = self.step()
            count += applied
            if i + 1 < steps:
                sleep(wait)
        return count


def within(seconds: float, answer: Callable[[], list], log: Callable[[str, float], None]) -> list:
    """The answer if it comes in time, else nothing; the outcome (injected, quiet, timeout) is logged either way."""
    began = time.monotonic()
    pool = ThreadPoolExecutor(1)
    try:
        task: Future = pool.submit(answer)
        out = task.result(timeout=seconds)
        log("injected" if out else "quiet", (time.monotonic() - began) * 1000)
        return out
    except Late:
        log("timeout", (time.monotonic() - began) * 1000)
        return []
    finally:
        pool.shutdown(wait=False)
