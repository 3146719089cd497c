"""Runs tasks that depend on each other: retries, time limits, conditions, one run at a time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Task:
    """run_if: all_success, at_least_one_success or all_done of what it needs."""

    name: str
    run: Callable[[], object]
    needs: tuple[str, ...] = ()
    retries: int = 0
    timeout: float | None = None
    run_if: str = "all_success"


@dataclass
class Job:
    """Tasks in the order that their needs allow; those that need not wait for each other run side by side. alarm: seconds of the
    whole run beyond which the result says slow."""

    name: str
    tasks: list[Task]
    parallel: int = 4
    schedule: str | None = None
    paused: bool = True
    alarm: float | None = None
    _running: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        known, done = {t.name: t for t in self.tasks}, set()
        if len(known) != len(self.tasks) or any(n not in known for t in self.tasks for n in t.needs):
            raise ValueError("a task's name is not unique, or a task needs one that there is not")
        while len(done) < len(known):
            ready = {t.name for t in self.tasks if t.name not in done and {*t.needs} <= done}
            if not ready:
                raise ValueError("tasks need each other in a circle")
            done |= ready

    def run(self) -> dict[str, dict]:
        """state (success, failed, timed_out, skipped), attempts, seconds, value or error of each task."""
        if not self._running.acquire(blocking=False):
            raise RuntimeError(f"{self.name} is running")
        began, results = time.monotonic(), {}
        try:
            with ThreadPoolExecutor(self.parallel) as pool:
                waiting, running = {t.name: t for t in self.tasks}, {}
                while waiting or running:
                    for t in [t for t in waiting.values() if all(n in results for n in t.needs)]:
                        del waiting[t.name]
                        if self._allowed(t, results):
                            running[pool.submit(self._attempt, t)] = t
                        else:
                            results[t.name] = {"state": "skipped", "attempts": 0, "seconds": 0.0}
                    if running:
                        done: set[Future]
                        done, _ = wait(running, return_when=FIRST_COMPLETED)
                        for f in done:
                            results[running.pop(f).name] = f.result()
        finally:
            self._running.release()
        took = time.monotonic() - began
        return results | {"_run": {"state": "success" if all(r["state"] in ("success", "skipped") for r in results.values()) else "failed", "seconds": took, "slow": self.alarm is not None and took > self.alarm}}

    @staticmethod
    def _allowed(t: Task, results: dict[str, dict]) -> bool:
        states = [results[n]["state"] == "success" for n in t.needs]
        return {"all_success": all(states), "at_least_one_success": not states or any(states), "all_done": True}[t.run_if]

    @staticmethod
    def _attempt(t: Task) -> dict:
        began = time.monotonic()
        for attempt in range(1, t.retries + 2):
            box: dict = {}

            def call(box=box) -> None:
                try:
                    box["value"] = t.run()
                except Exception as e:  # a task may fail in any way
                    box["error"] = repr(e)

            thread = threading.Thread(target=call, daemon=True)
            thread.start()
            thread.join(t.timeout)
            state = "timed_out" if thread.is_alive() else "failed" if "error" in box else "success"
            if state == "success" or attempt > t.retries:
                return {"state": state, "attempts": attempt, "seconds": time.monotonic() - began, **box}
        raise AssertionError
