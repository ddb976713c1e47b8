"""Wall time by stage of a run, taken on the driver while it waits for the jobs of a stage."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

OTHER = "other"


class Clock:
    """Calls and seconds of named stages; stages do not overlap, and what no stage takes is ``other``."""

    def __init__(self, now=time.perf_counter):
        self._now, self._began, self._wall = now, None, 0.0
        self.stages: dict[str, tuple[int, float]] = {}

    @contextmanager
    def running(self) -> Iterator[Clock]:
        """The whole run; may be entered again, times add up."""
        self._began = self._now()
        try:
            yield self
        finally:
            self._wall += self._now() - self._began
            self._began = None

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = self._now()
        try:
            yield
        finally:
            calls, seconds = self.stages.get(name, (0, 0.0))
            self.stages[name] = calls + 1, seconds + self._now() - began

    @property
    def wall(self) -> float:
        return self._wall + (self._now() - self._began if self._began is not None else 0.0)

    def calls(self, name: str) -> int:
        return self.stages.get(name, (0, 0.0))[0]

    def rows(self) -> list[tuple[str, int, float, float]]:
        """(stage, calls, seconds, mean seconds), ``other`` last, so that seconds add up to the wall time."""
        out = [(name, calls, seconds, seconds / calls) for name, (calls, seconds) in self.stages.items()]
        rest = max(0.0, self.wall - sum(r[2] for r in out))
        return [*out, (OTHER, 1, rest, rest)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "stage string, calls long, seconds double, mean double")
