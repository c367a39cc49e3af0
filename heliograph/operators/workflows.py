"""Workflows over signals: registered steps that run in order for each row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A step adds the column ``name`` to a row's context.

    ``output`` is its value, and ``error`` a message where the step fails, null where it succeeds. ``condition`` says
    for which rows the step is taken; where it is null, the step is taken.
    """

    name: str
    output: Column
    condition: Column | None = None
    error: Column | None = None


class Registry:
    """Named workflows; a name is registered once, and a workflow's steps have different names."""

    def __init__(self) -> None:
        self.workflows: dict[str, tuple[Step, ...]] = {}

    def register(self, name: str, steps: Sequence[Step]) -> None:
        if name in self.workflows:
            raise ValueError(f"there is a workflow {name} already")
        if len({s.name for s in steps}) < len(steps):
            raise ValueError(f"steps of {name} share a name")
        self.workflows[name] = tuple(steps)

    def run(self, name: str, signals: DataFrame) -> DataFrame:
        return run(signals, self.workflows[name])


def run(signals: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Adds each step's output, then steps (array of step and status), status and error.

    A step's condition and output may use the outputs of steps before it. After a failure no step is run, the row's
    status is FAILED and its steps end with the failed one. Steps are projections, so that a workflow needs no shuffle.
    """
    out = signals.withColumns({"_error": F.lit(None).cast("string"), "_steps": F.array().cast("array<struct<step:string,status:string>>")})
    for step in steps:
        taken = F.lit(True) if step.condition is None else F.coalesce(step.condition, F.lit(True))
        out = out.withColumn("_running", F.col("_error").isNull()).withColumn("_taken", F.col("_running") & taken)
        failure = F.lit(None).cast("string") if step.error is None else F.when(F.col("_taken"), step.error)
        out = out.withColumn("_failure", failure)
        status = F.when(~F.col("_taken"), "SKIPPED").when(F.col("_failure").isNotNull(), "FAILED").otherwise("COMPLETED")
        said = F.when(F.col("_running"), F.array_append("_steps", F.struct(F.lit(step.name).alias("step"), status.alias("status")))).otherwise(F.col("_steps"))
        value = F.when(F.col("_taken") & F.col("_failure").isNull(), step.output)
        out = out.withColumns({step.name: value, "_steps": said, "_error": F.coalesce("_error", "_failure")})
    ended = F.when(F.col("_error").isNull(), "COMPLETED").otherwise("FAILED")
    return out.withColumns({"steps": F.col("_steps"), "status": ended, "error": F.col("_error")}).drop("_running", "_taken", "_failure", "_steps", "_error")
