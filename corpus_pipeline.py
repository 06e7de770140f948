"""A corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, benchmark
passages are cut out, and the rest is encoded. Each stage is written as Parquet in the shared folder and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from swathkit.llm import bpe, common, decontam, linededup, ngram_join, toxicity

ORACLE_SQL = None  # a trained model, edit distances and an automaton: tested against brute force instead


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts are scored like any other; rows that share an id are scored each; an empty table stays empty; all
    columns stay, whatever their names.
    """
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, but for the first; documents of nothing else go too.

    Null and empty texts and rows without an id stay; rows that share an id lose lines of their own texts only; of equal or
    near lines in one document the first place stays; all columns stay, whatever their names.
    """
    return linededup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows without an id or without words stay; rows that repeat an id and its text stay or go together, other texts of that
    id stay; all columns stay, whatever their names.
    """
    return ngram_join.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts.

    No document goes; null and empty texts stay; repeated rows and items change nothing; all columns stay, whatever their names.
    """
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of the texts that are left; decoding gives each text back, a null text counts as
    empty. The other columns end here; repeated rows repeat."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of a data folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
