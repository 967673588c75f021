"""Sinks: delimited and Parquet output, publication with upper-case names, and a commit of versions by pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def csv_parts(df: DataFrame, path: str, rows_per_file: int = 1_000_000, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("maxRecordsPerFile", rows_per_file).csv(path)


def published(df: DataFrame) -> DataFrame:
    """Upper-case names and times without zone, as a warehouse takes them."""
    out = df.select(*(df[c].cast("timestamp_ntz") if t == "timestamp" else df[c] for c, t in df.dtypes))
    return out.toDF(*(c.upper() for c in df.columns))


def page(df: DataFrame, order: list[str], offset: int, size: int) -> dict:
    """Total and the rows of a page as JSON-ready values."""
    return {"total": df.count(), "rows": [r.asDict(recursive=True) for r in df.orderBy(*order).offset(offset).limit(size).collect()]}


class Versions:
    """Tables under a folder in versions. A version is there for readers once its pointer is, which is written aside and then
    renamed, last of all, to a number that rises by one; a rename doesn't replace, so of two commits at once one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        """Numbers of the pointers, in order."""
        if not self._fs.exists(self._at("pointers")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("pointers"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _current(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{self._numbers()[-1]:012d}").first()[0])

    def commit(self, tables: dict[str, DataFrame], check=lambda name, df: True, notes: dict | Callable[[Callable[[str], DataFrame]], dict] | None = None) -> str:
        """Write all tables as a new version, check them as written, then rename its pointer. notes: JSON to keep with it, or a function
        that gives it once the tables are written, and that can read them by name."""
        version, before = f"v-{uuid.uuid4().hex}", self._numbers()
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.path}/{version}/{name}")
        if not all(check(n, self.spark.read.parquet(f"{self.path}/{version}/{n}")) for n in tables):
            self._fs.delete(self._at(version), True)
            raise ValueError("a table failed its check; the version before stays")
        if callable(notes):
            notes = notes(lambda name: self.spark.read.parquet(f"{self.path}/{version}/{name}"))
        out = self._fs.create(self._at(f"{version}/pointer"), True)
        out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables), "notes": notes or {}}).encode()))
        out.close()
        self._fs.mkdirs(self._at("pointers"))
        pointer = self._at(f"pointers/{before[-1] + 1 if before else 0:012d}")
        if self._fs.exists(pointer) or not self._fs.rename(self._at(f"{version}/pointer"), pointer):
            raise RuntimeError("another version was committed meanwhile")
        return version

    def versions(self) -> list[str]:
        """All versions, the current one last."""
        return [json.loads(self.spark.read.text(f"{self.path}/pointers/{n:012d}").first()[0])["version"] for n in self._numbers()]

    def discard(self, keep: int = 1) -> None:
        """Delete all but the last versions, first their pointers."""
        every = list(zip(self._numbers(), self.versions(), strict=True))
        for number, version in every[: max(0, len(every) - keep)]:
            self._fs.delete(self._at(f"pointers/{number:012d}"), False)
            self._fs.delete(self._at(version), True)

    def notes(self) -> dict:
        return self._current()["notes"] if self._numbers() else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._current()['version']}/{name}")
