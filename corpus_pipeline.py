"""A corpus made ready for training: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardwise.llm.crf_pii import redacted
from wardwise.llm.edit_leaks import without_leaks
from wardwise.llm.noisy_toxicity import without_toxic
from wardwise.llm.path_join import near_duplicates
from wardwise.llm.store import written
from wardwise.llm.trie_bpe import bpe, vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go. Null and empty texts score as texts without words; rows without doc_id are scored too; repeated rows stay or go together."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays, with all its rows; so does every document without a
    doc_id, and every null or empty text, which is alike with nothing."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and rows without doc_id stay; an empty benchmark removes nothing."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. Null texts stay null; all rows stay, with their other columns."""
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become tokens; digests of both directions go with them. Null and empty texts have no tokens; every row gives one, text, lang and source are left behind."""
    return bpe(docs, vocabulary()).drop("decoded")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("tokens", tokens)]

ORACLE_SQL = None  # classifiers, edit distances and tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
