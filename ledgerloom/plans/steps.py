"""Steps of a pipeline with a status each: what failed, what may fail, and what is tried again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class StepFailed(RuntimeError):
    """A step that must not fail has failed."""


@dataclass
class Steps:
    """Runs named steps once each. A step's result is kept; an exception becomes its error.

    Steps in ``may_fail`` leave a warning and the default that was given; others end the run.
    """

    may_fail: frozenset[str] = frozenset()
    done: dict[str, Any] = field(default_factory=dict)
    log: list[tuple[str, str, str | None]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def run(self, name: str, make: Callable[[], Any], default: Callable[[], Any] | None = None, again: Callable[[], Any] | None = None) -> Any:
        """The step's result: of ``make``, of ``again`` if that fails, or the default. A step that is done isn't run again."""
        if name in self.done:
            return self.done[name]
        for attempt in (make, again):
            if attempt is None:
                continue
            try:
                self.done[name] = attempt()
                self.log.append((name, "OK", None))
                return self.done[name]
            except Exception as error:  # noqa: BLE001  a step reports whatever went wrong in it
                self.log.append((name, "ERROR", f"{name} failed: {error}"))
        message = self.log[-1][2]
        if name not in self.may_fail:
            raise StepFailed(message)
        self.warnings.append(f"Stage '{name}' failed and was skipped: {message}")
        return default() if default else None

    def reopen(self, *names: str) -> None:
        """Forget that these steps are done, as what they were made from has changed."""
        for name in names:
            self.done.pop(name, None)

    def statuses(self, spark: SparkSession) -> DataFrame:
        """step_no, step, status, message of every attempt in order."""
        rows = [(i, *entry) for i, entry in enumerate(self.log)]
        return spark.createDataFrame(rows, "step_no int, step string, status string, message string")
