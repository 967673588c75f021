"""Readers of raw feeds. Every column of a delimited feed is a string; casts belong to staging."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Columns that name each kind of feed, the most telling first.
FEEDS = {"consumption": {"log_id", "total_quantity"}, "invoices": {"invoice_number"}, "purchase_orders": {"po_number"}, "contracts": {"contract_number", "contract_price"}, "item_master": {"item_id", "unspsc"}}


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "|", relaxed: bool = False, keep_blanks: bool = False) -> DataFrame:
    """A feed with a header line. Short rows are filled with nulls. relaxed: quotes may hold line ends. keep_blanks: '' stays ''."""
    reader = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
    if relaxed:
        reader = reader.option("quote", '"').option("escape", '"').option("multiLine", True)
    df = (reader.schema(strings(columns)) if columns else reader).csv(path)
    return df.na.fill("") if keep_blanks else df


def quarantined(spark: SparkSession, path: str, columns: list[str], sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of a feed with a header line: short rows are filled with nulls, and rows that hold more fields than there are columns,
    or a quote that isn't closed, go to bad (_bad, _source_file) as they were."""
    schema = strings([*columns, "_bad"])
    reader = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    df = written(reader.schema(schema).csv(path).withColumn("_source_file", F.col("_metadata.file_name")), "parsed")  # for both results
    fields = F.size(F.split(F.col("_bad"), re.escape(sep), -1))
    open_quote = F.length(F.regexp_replace("_bad", '[^"]', "")) % 2 == 1
    wrong = F.col("_bad").isNotNull() & ((fields > len(columns)) | open_quote)
    return df.where(~wrong).select(*columns), df.where(wrong).select("_bad", "_source_file")


def inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(path)


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that the first five lines have most of."""
    text = "\n".join(r[0] for r in spark.read.text(path).limit(5).collect())
    return max("|,\t;", key=text.count)


def or_empty(spark: SparkSession, path: str, columns: list[str], **how) -> DataFrame:
    """The feed, or no rows of its columns where there is no file."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return delimited(spark, path, columns, **how) if there else spark.createDataFrame([], strings(columns))


def discover(spark: SparkSession, *patterns: str) -> list[str]:
    """The files of the first pattern that has some, on any store that Spark reaches, in natural order: part 2 before part 10.

    A pattern whose store can't be reached counts as one without files, so a local folder can follow a remote one.
    """
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        try:
            found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
        except Py4JJavaError:
            continue
        paths = [f.getPath().toString() for f in found if f.isFile() and f.getLen()]
        if paths:
            return sorted(paths, key=lambda p: [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", p)])
    raise FileNotFoundError(f"no files match {', '.join(patterns)}")


def parts(spark: SparkSession, *patterns: str, sep: str = ",") -> DataFrame:
    """All rows of the files of a feed in parts, by column name, with _source_file and its place _source_index in natural order.

    Every file has a header of the same columns, in any order; else the error names the files that differ.
    """
    paths = discover(spark, *patterns)
    headers = {p: tuple(spark.read.text(p).first()[0].split(sep)) for p in paths}  # a line of each file
    wrong = [p for p in paths if set(headers[p]) != set(headers[paths[0]])]
    if wrong:
        raise ValueError(f"columns other than those of {paths[0]}: {', '.join(wrong)}")
    alike: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        alike.setdefault(headers[p], []).append(p)
    read = lambda columns, files: spark.read.option("sep", sep).option("header", True).schema(strings(list(columns))).csv(files).withColumn("_source_file", F.col("_metadata.file_path"))
    rows = reduce(DataFrame.unionByName, (read(c, files) for c, files in alike.items()))
    index = spark.createDataFrame([(_plain(p), i) for i, p in enumerate(paths)], "file string, _source_index int")
    return rows.join(F.broadcast(index), F.regexp_replace("_source_file", "^[a-z0-9]+:/+", "/") == F.col("file")).drop("file")


def _plain(path: str) -> str:
    """The path without scheme, which is written in more than one way."""
    return re.sub("^[a-z0-9]+:/+", "/", path)


def kind(columns: list[str]) -> str:
    """The kind of feed that columns speak for."""
    have = {c.lower() for c in columns}
    return max(FEEDS, key=lambda k: (len(FEEDS[k] & have) / len(FEEDS[k]), -list(FEEDS).index(k)))


#: What in a file's name, in lower case, tells its kind, the first that fits.
FILE_NAMES = {"purchase_orders": "po[_-]|purchase", "invoices": "inv", "contracts": "con_|contract", "item_master": "item|im_", "consumption": "consum|usage"}


def kind_of_file(name: Column) -> Column:
    """The kind of feed that a file's name speaks for, else unknown."""
    out = F.lit("unknown")
    for kind_, pattern in reversed(FILE_NAMES.items()):
        out = F.when(F.lower(name).rlike(pattern), kind_).otherwise(out)
    return out


def with_audit(df: DataFrame) -> DataFrame:
    """With the file that each row comes from and the time of reading."""
    return df.withColumns({"_source_file": F.col("_metadata.file_name"), "_ingested_at": F.current_timestamp()})
