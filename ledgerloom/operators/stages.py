"""A run as a graph of stages: each stage's result is committed as a version of its own, and a run resumes after what it has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import Versions
from .manifest import fingerprint


@dataclass(frozen=True)
class Stage:
    """name, a function of its inputs' results (DataFrames by name), their names, and settings that its result depends on."""

    name: str
    work: Callable[..., DataFrame]
    after: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict, hash=False)


class Run:
    """The state of a run under a path. A stage is finished once its version is committed under the key of its settings and of its
    inputs' versions; a later call repeats no finished stage, and every stage after one that changed."""

    def __init__(self, spark: SparkSession, path: str, stages: list[Stage]):
        self.spark, self.path = spark, path.rstrip("/")
        self.stages = {s.name: s for s in stages}
        self.order: list[str] = []
        for s in stages:
            self._place(s.name, ())

    def _place(self, name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"stages in a circle: {' > '.join((*above, name))}")
        for x in self.stages[name].after:
            self._place(x, (*above, name))
        if name not in self.order:
            self.order.append(name)

    def store(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{name}")

    def _key(self, name: str) -> str:
        s = self.stages[name]
        return fingerprint({"stage": name, "settings": s.settings, "inputs": {x: self.store(x).versions()[-1:] for x in s.after}})

    def finished(self, name: str) -> bool:
        return all(self.finished(x) for x in self.stages[name].after) and self.store(name).notes().get("key") == self._key(name)

    def states(self) -> dict[str, str]:
        """FINISHED, or PENDING, of each stage, in the order in which they run."""
        return {n: "FINISHED" if self.finished(n) else "PENDING" for n in self.order}

    def resume(self) -> list[str]:
        """Run what isn't finished. Returns the names of the stages that ran; an error leaves those before it finished."""
        ran = []
        for name in self.order:
            if not self.finished(name):
                s = self.stages[name]
                self.store(name).commit({"out": s.work(*(self.read(x) for x in s.after))}, notes={"key": self._key(name)})
                ran.append(name)
        return ran

    def read(self, name: str) -> DataFrame:
        return self.store(name).read("out")

    def forget(self, name: str) -> None:
        """Drop a stage's results, so that it and what follows run again."""
        self.store(name).discard(keep=0)
