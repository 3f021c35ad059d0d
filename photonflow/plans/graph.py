"""Pipelines as graphs of named stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonflow.functions.stats import DONE, stage_stats, stats_line
from photonflow.operators.tables import stable


@dataclass(frozen=True)
class Stage:
    """``work(run, rows)`` takes the rows of the stages ``after`` that were done (the listing for a first one) and returns rows with ``rel_path``.

    Rows that it leaves out are rejected. With a column ``outcome`` (and ``output_count``) it tells itself what became of each; only done rows go on.
    """

    name: str
    work: Callable[[object, DataFrame], DataFrame]
    after: tuple[str, ...] = ()


class Pipeline:
    """Stages by name. A pipeline that lacks a stage, or in which one waits for itself, does not run."""

    def __init__(self, *stages: Stage) -> None:
        self.stages: dict[str, Stage] = {}
        for s in stages:
            self.add_task(s)

    def add_task(self, stage: Stage) -> Pipeline:
        if stage.name in self.stages:
            raise ValueError(f"there is a stage {stage.name!r}")
        self.stages[stage.name] = stage
        return self

    def get_task(self, name: str) -> Stage:
        if name not in self.stages:
            raise ValueError(f"no stage {name!r}; there are: {', '.join(self.stages)}")
        return self.stages[name]

    def get_all_tasks(self) -> dict[str, Stage]:
        return dict(self.stages)

    def order(self) -> list[Stage]:
        """Every stage after those that it waits for; otherwise as they were added."""
        out: list[Stage] = []
        left = dict(self.stages)
        for s in left.values():
            for name in s.after:
                self.get_task(name)
        while left:
            ready = [s for s in left.values() if not set(s.after) & set(left)]
            if not ready:
                raise ValueError(f"stages that wait for each other: {', '.join(left)}")
            out.append(ready[0])
            del left[ready[0].name]
        return out

    def run(self, run: object, listing: DataFrame, tell: Callable[[str, str], None] = lambda name, line: None) -> dict[str, str]:
        """Run all stages; -> the counters of each as a line. ``tell`` gets each line when its stage is done."""
        made: dict[str, DataFrame] = {}
        lines = {}
        for s in self.order():
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [made[n] for n in s.after]) if s.after else listing
            out = stable(s.work(run, rows), s.name)
            if "outcome" in out.columns:
                counted = stage_stats(out.withColumn("output_count", F.col("output_count")) if "output_count" in out.columns else out.withColumn("output_count", F.lit(1)))
                c = F.col
                lines[s.name] = counted.select(stats_line(c("input"), c("output"), c("failed"), c("rejected"), c("diff")).alias("line")).first()["line"]
                made[s.name] = out.where(F.col("outcome") == DONE).drop("outcome", "output_count")
            else:
                n, rejected = out.count(), rows.join(out.select("rel_path").distinct(), "rel_path", "left_anti").count()
                lines[s.name] = (f"{rejected}R" if rejected else "") + f"{n}D"
                made[s.name] = out
            tell(s.name, lines[s.name])
        return lines
