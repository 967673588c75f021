"""Queries that apply the operators of this package to the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    best_fit_packing, chat_grammar, filter_audit, importance_quality, kd_tree_topk, min_cut_extract, ngram_jaccard_join, ordinal_toxicity,
    phrase_mining, secret_ledger, source_mixing, spaced_seeds, warc_captures,
)
from .common import Scratch
from .oracle import ORACLE  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write archives of all pages, read them back, assemble the captures."""
    scratch = Scratch(spark)
    warc_captures.write(_table(spark, sf_dir, "pages"), path := scratch.place("warc"), scratch=scratch)
    records = scratch.cut(warc_captures.read_records(spark, path, with_payload=False), "records")  # parsed once
    captures = warc_captures.assemble(records, scratch)
    return captures.select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), "refers_to", F.col("request.uri").alias("request_uri"),
    )


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's overlap with every benchmark item that it holds."""
    return spaced_seeds.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return best_fit_packing.pack(best_fit_packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_min_cut_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return min_cut_extract.extract(_table(spark, sf_dir, "pages"))


def op5_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and -7, whose texts hold control strings, formatted, written and read back."""
    hard = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    written = Scratch(spark).cut(chat_grammar.format_conversations(rows.unionAll(more)), "formatted")
    back = chat_grammar.read_back(written)
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 3-word shingles, Jaccard similarity of at least 0.9."""
    return ngram_jaccard_join.annotate(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets in all documents: a first run fills the ledger with the base rules, a second one, with all rules, scans what the
    ledger lacks."""
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark)
    base = tuple(r for r in secret_ledger.RULES if r.base)
    ledger = scratch.cut(secret_ledger.scan(docs, rules=base), "first_run")
    return secret_ledger.report(docs, ledger, scratch=scratch)


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity."""
    return ordinal_toxicity.severity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_kd_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other rows by inner product for every row whose vec_id is divisible by 20."""
    return kd_tree_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards good ones draws."""
    return importance_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).where("keep").drop("keep")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 5, 2, 1, repeating, 150 % of all words, two epochs at most."""
    return source_mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over all documents, for each lang."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each lang that hold together most."""
    return phrase_mining.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_transactions, op2_spaced_seeds, op3_best_fit_packing, op4_min_cut_extract, op5_chat_grammar, op6_ngram_jaccard_join,
        op7_secret_ledger, op8_ordinal_toxicity, op9_kd_tree_topk, op10_importance_quality,
        op11_source_mixing, op12_filter_audit, op13_phrase_mining,
    )
}

