"""Publication of tables: a data source whose tasks write chunks aside and whose commit makes them the table, all or none.

Rows arrive as Arrow batches. Each task writes chunks of at most ``chunk`` rows as Parquet files of a run of their own; the commit
writes the list of the run's files and renames it over the pointer that readers follow. A failed run deletes its files, and the table
before stays. Names are in upper case and times without zone, as a warehouse takes them. The folder is any URI that pyarrow's
file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .sinks import published

FORMAT = "published_table"


@dataclass
class Chunks(WriterCommitMessage):
    files: list[str]
    rows: int


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class PublishedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ChunkWriter(self.options["path"], int(self.options.get("chunk", 100_000)), uuid.uuid4().hex, overwrite)


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, chunk: int, run: str, overwrite: bool):
        self.uri, self.chunk, self.run, self.overwrite = uri.rstrip("/"), chunk, run, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Chunks:
        import pyarrow.parquet as pq

        fs, top = _open(self.uri)
        task = TaskContext.get()
        folder = f"{top}/{self.run}/{task.partitionId()}-{task.taskAttemptId()}"  # an attempt that fails leaves no name that another one takes
        held: list[pa.RecordBatch] = []
        files, total, waiting = [], 0, 0

        def put(most: int) -> None:
            nonlocal held, waiting
            table = pa.Table.from_batches(held)
            held, waiting = table.slice(most).to_batches(), max(0, table.num_rows - most)
            fs.create_dir(folder, recursive=True)
            files.append(f"{folder}/{len(files):05d}.parquet")
            pq.write_table(table.slice(0, most), files[-1], filesystem=fs)

        for batch in iterator:
            total, waiting = total + batch.num_rows, waiting + batch.num_rows
            held.append(batch)
            while waiting >= self.chunk:
                put(self.chunk)
        if waiting:
            put(self.chunk)
        return Chunks(files, total)

    def commit(self, messages: list[Chunks | None]) -> None:
        fs, top = _open(self.uri)
        files = [f for m in messages if m for f in m.files]
        before = [] if self.overwrite else current(self.uri).get("files", [])
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/pointer-{self.run}") as out:
            out.write(json.dumps({"run": self.run, "files": before + files, "rows": sum(m.rows for m in messages if m)}).encode())
        fs.move(f"{top}/pointer-{self.run}", f"{top}/pointer")

    def abort(self, messages: list[Chunks | None]) -> None:
        fs, top = _open(self.uri)
        if fs.get_file_info(f"{top}/{self.run}").type.name == "Directory":
            fs.delete_dir(f"{top}/{self.run}")


def current(uri: str) -> dict:
    """The pointer's run, files and rows of the last commit; nothing before the first one."""
    fs, top = _open(uri.rstrip("/"))
    if fs.get_file_info(f"{top}/pointer").type.name != "File":
        return {}
    with fs.open_input_stream(f"{top}/pointer") as at:
        return json.loads(at.read())


def publish(df: DataFrame, uri: str, chunk: int = 100_000, mode: str = "overwrite") -> dict:
    """Publish df's rows as the table at uri, in place of or after (mode append) those before. Returns what was committed."""
    df.sparkSession.dataSource.register(PublishedTable)
    published(df).write.format(FORMAT).mode(mode).option("path", uri).option("chunk", chunk).save()
    return current(uri)


def read_published(spark: SparkSession, uri: str) -> DataFrame:
    scheme = uri.split(":", 1)[0] + "://" if "://" in uri else ""
    return spark.read.parquet(*(scheme + f for f in current(uri)["files"]))
