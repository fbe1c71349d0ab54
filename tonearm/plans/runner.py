"""Ordered phases with a dry run: a plan is a DataFrame, applying it writes a new version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Phases in the order that their results depend on each other: tempo repair before anything bucketed by tempo.
PHASES = ("analyse", "repair_tempo", "tag", "cluster", "match", "score", "export")


@dataclass
class Step:
    phase: str
    plan: Callable[[SparkSession], DataFrame]
    apply: Callable[[DataFrame], None]
    guard: Callable[[DataFrame], str | None] = lambda plan: None


@dataclass
class Runner:
    spark: SparkSession
    steps: list[Step] = field(default_factory=list)

    def add(self, step: Step) -> None:
        if step.phase not in PHASES:
            raise ValueError(f"unknown phase {step.phase}")
        self.steps.append(step)

    def run(self, apply: bool = False) -> list[tuple[str, DataFrame]]:
        """The plans in order; with ``apply`` each is applied unless its guard names a problem."""
        out = []
        for step in sorted(self.steps, key=lambda s: PHASES.index(s.phase)):
            plan = step.plan(self.spark)
            out.append((step.phase, plan))
            if apply:
                problem = step.guard(plan)
                if problem:
                    raise RuntimeError(f"{step.phase}: {problem}")
                step.apply(plan)
        return out


def write_version(path: str, version: int) -> Callable[[DataFrame], None]:
    """Writes a plan as one more version; versions before it stay."""
    return lambda plan: plan.write.mode("errorifexists").parquet(f"{path}/version={version}")
