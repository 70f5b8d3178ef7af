"""A small workflow of steps whose results are stored: a step runs if its marker is missing or older than an input's."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.storage import load, marker_path, save


@dataclass(frozen=True)
class Step:
    """make(spark, inputs) gives the step's result; inputs are the results of the steps named."""

    name: str
    make: Callable[..., DataFrame]
    inputs: Sequence[str] = ()
    files: Sequence[str] = ()


@dataclass
class Workflow:
    spark: SparkSession
    folder: str
    steps: dict[str, Step] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)

    def add(self, name: str, make: Callable[..., DataFrame], *inputs: str, files: Sequence[str] = ()) -> Workflow:
        if missing := [i for i in inputs if i not in self.steps]:
            raise ValueError(f"{name} needs steps that aren't there: {', '.join(missing)}")
        self.steps[name] = Step(name, make, inputs, files)
        return self

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _time(self, path: str) -> int | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

    def result(self, name: str) -> DataFrame:
        """The step's stored result, made first where it is missing or out of date."""
        step = self.steps[name]
        inputs = [self.result(i) for i in step.inputs]
        own = self._time(marker_path(self.path(name)))
        times = [self._time(marker_path(self.path(i))) for i in step.inputs] + [self._time(f) for f in step.files]
        if own is None or any(t is not None and t > own for t in times):
            save(step.make(self.spark, *inputs), self.path(name))
            self.ran.append(name)
        return load(self.path(name), self.spark)
