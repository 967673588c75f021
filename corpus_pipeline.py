"""The corpus pipeline: documents that the quality classifier rejects go, one document of each group of near duplicates stays,
documents that hold benchmark items go, secrets are redacted, and what is left is packed into sequences.

In all stages a null text is the empty text and stays null where the row stays, null doc_ids are kept apart from all others, rows that
repeat a doc_id stay or go together, extra columns come through unchanged whatever their names, and no rows give no rows. All stages
but the last return the columns of their documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import best_fit_packing, importance_quality, ngram_jaccard_join, secret_ledger, spaced_seeds
from ledgerloom.llm.common import Scratch
from ledgerloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards good labels draws. Ties of the noisy scores go by doc_id; an empty text has the
    importance of no words; without labels of both kinds all documents stay."""
    return importance_quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: of each group that such links connect, the document with the smallest doc_id stays.
    Texts of under five words are one shingle; texts without words link with nothing and stay."""
    return ngram_jaccard_join.representatives(docs, k=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go. Items of under five words, null or empty ones aren't searched; texts without words stay."""
    return spaced_seeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew where a text has changed."""
    return secret_ledger.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences and offsets. An empty text is its end mark alone; repeated rows are pieces each."""
    return best_fit_packing.pack(best_fit_packing.pieces(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
