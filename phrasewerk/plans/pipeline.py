"""Steps of a process: planning, running with a status table, stopping and deleting."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from phrasewerk.sources.store import ArtifactStore

STEPS = ("data", "embedding", "clustering", "graph", "integration")
PENDING, RUNNING, FINISHED, ABORTED, STOPPED, SKIPPED = "pending", "running", "finished", "aborted", "stopped", "skipped"


@dataclass
class Step:
    """A step computes its table from the tables of the steps before it."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Process:
    """Runs steps in order in one thread; a failed or stopped step aborts the later ones."""

    spark: SparkSession
    name: str
    store: ArtifactStore
    steps: list[Step]
    status: dict[str, str] = field(default_factory=dict)
    error: Exception | None = None

    def __post_init__(self) -> None:
        self.status = {s.name: PENDING for s in self.steps}
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def plan(self, skip_present: bool = True, omit: set[str] | None = None) -> dict[str, str]:
        """What will be done with each step: omit, reuse or compute; a step after a computed one is computed."""
        out, fresh = {}, False
        for s in self.steps:
            if s.name in (omit or set()):
                out[s.name] = "omit"
            elif skip_present and not fresh and self.store.has(self.name, s.name):
                out[s.name] = "reuse"
            else:
                out[s.name], fresh = "compute", True
        return out

    def run(self, skip_present: bool = True, omit: set[str] | None = None) -> None:
        made: dict[str, DataFrame] = {}
        plan = self.plan(skip_present, omit)
        self.spark.sparkContext.addJobTag(f"process-{self.name}")
        try:
            for i, s in enumerate(self.steps):
                if self._stop.is_set():
                    self._end(i, STOPPED)
                    return
                if plan[s.name] != "compute":
                    self.status[s.name] = SKIPPED
                    if self.store.has(self.name, s.name):
                        made[s.name] = self.store.table(self.name, s.name)
                    continue
                self.status[s.name] = RUNNING
                try:
                    made[s.name] = self.store.save(s.run(made), self.name, s.name)
                except Exception as e:  # noqa: BLE001
                    self.error = e
                    self._end(i, STOPPED if self._stop.is_set() else ABORTED)
                    return
                self.status[s.name] = FINISHED
        finally:
            self.spark.sparkContext.removeJobTag(f"process-{self.name}")

    def _end(self, i: int, status: str) -> None:
        self.status[self.steps[i].name] = status
        for s in self.steps[i + 1 :]:
            self.status[s.name] = ABORTED

    def start(self, **options) -> threading.Thread:
        self._thread = threading.Thread(target=self.run, kwargs=options, daemon=True)
        self._thread.start()
        return self._thread

    def result(self, timeout: float | None = None) -> DataFrame | None:
        """Waits for the thread: the last step's table, None if a step failed or was stopped."""
        if self._thread:
            self._thread.join(timeout)
        last = self.steps[-1].name if self.steps else None
        done = all(s in (FINISHED, SKIPPED) for s in self.status.values())
        return self.store.table(self.name, last) if last and done and self.store.has(self.name, last) else None

    def status_rows(self) -> list[tuple[str, str, int, str]]:
        """(process, step, rank, status) in order of rank."""
        return [(self.name, s.name, i, self.status[s.name]) for i, s in enumerate(self.steps)]

    def current(self) -> str | None:
        """The first step in order of rank that is not done."""
        return next((s.name for s in self.steps if self.status[s.name] not in (FINISHED, SKIPPED)), None)

    def stop(self, hard: bool = False) -> None:
        """The running step is the last; *hard* also cancels its jobs."""
        self._stop.set()
        if hard:
            self.spark.sparkContext.cancelJobsWithTag(f"process-{self.name}")

    def delete(self) -> bool:
        """Waits for the thread and deletes all tables of the process."""
        if self._thread:
            self.stop()
            self._thread.join()
        return self.store.delete(self.name)
