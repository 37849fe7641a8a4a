"""Saved actions: named steps over a frame, run in order; the first that fails names itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    name: str
    apply: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...] = field(default=())

    @staticmethod
    def of(*steps: Step) -> Pipeline:
        if not 1 <= len(steps) <= 20:
            raise ValueError("an action has 1 to 20 steps")
        return Pipeline(tuple(steps))

    def then(self, name: str, apply: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline.of(*self.steps, Step(name, apply))

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            try:
                df = df.transform(step.apply)
            except Exception as e:
                raise RuntimeError(f"step {step.name!r} failed: {e}") from e
        return df
