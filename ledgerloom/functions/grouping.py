"""Labels for distinct values from a pluggable labeller, called in batches, with a rule as its offline default."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.shared import written
from ..sources.sinks import Versions

BATCH = 500


def rules(values: list[str]) -> list[str]:
    """Offline labels by keywords."""
    return ["ORTHO" if "plate" in v or "bolt" in v else "GENERAL" for v in values]


def group_values(values: DataFrame, labeller: Callable[[list[str]], list[str]], batch: int = BATCH) -> DataFrame:
    """(value, label) per distinct value; the labeller sees up to ``batch`` values at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame["value"].iloc[a : a + batch].tolist()
                yield pd.DataFrame({"value": part, "label": labeller([v or "" for v in part])})

    return values.select("value").distinct().mapInPandas(run, "value string, label string")


def unwrap(reply: str) -> list[dict]:
    """The objects of a reply: a JSON array, alone or in a fence of backquotes, or the first array inside a JSON object; none of anything
    else."""
    text = reply
    if "```" in text:
        text = text.split("```", 2)[1]
        text = text[4:] if text.lower().startswith("json") else text
    try:
        found = json.loads(text)
    except ValueError:
        return []
    if isinstance(found, dict):
        found = next((v for v in found.values() if isinstance(v, list)), [])
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


LABELS = "value string, label string, source string"


class LabelCache:
    """Labels of distinct values, kept over runs as committed versions. A client (a function from a batch of values to a reply in text)
    is asked only for values without a label from it; what a reply lacks, or a call that fails, gets the rule's label and is asked
    again by the next run."""

    def __init__(self, store: Versions, client: Callable[[list[str]], str], rule: Callable[[list[str]], list[str]] = rules, batch: int = BATCH):
        self.store, self.client, self.rule, self.batch = store, client, rule, batch

    def known(self) -> DataFrame:
        return self.store.read("labels") if self.store.versions() else self.store.spark.createDataFrame([], LABELS)

    def run(self, values: DataFrame) -> dict[str, int]:
        """Label the distinct values (value) and commit them. Returns how many were asked for, and how many the rule labelled."""
        client, rule, batch = self.client, self.rule, self.batch

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), batch):
                    part = frame["value"].iloc[a : a + batch].tolist()
                    try:
                        reply = client(part)
                    except Exception:  # whatever a service raises: the rule labels these for now
                        reply = ""
                    got = {str(x["value"]): str(x["label"]) for x in unwrap(reply) if x.get("value") is not None and x.get("label")}
                    for v, plain in zip(part, rule(part), strict=True):
                        yield pd.DataFrame({"value": [v], "label": [got.get(v, plain)], "source": ["CLIENT" if v in got else "RULE"]})

        known = self.known()
        new = values.where("value is not null").select("value").distinct().join(known.where("source = 'CLIENT'").select("value"), "value", "left_anti")
        asked = new.mapInPandas(ask, LABELS)
        asked = written(asked, "asked")  # asked once: what follows reads the replies
        counts = asked.groupBy("source").count().collect()
        kept = known.join(asked.select("value"), "value", "left_anti")
        self.store.commit({"labels": kept.unionByName(asked)})
        n = {r["source"]: r["count"] for r in counts}
        return {"asked": sum(n.values()), "by_rule": n.get("RULE", 0)}
