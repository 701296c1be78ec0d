"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import linededup, minhash, mixing, packing, quality
from tallyforge.llm.staging import col, drop_path, fresh_name, fresh_path, workspace
from tallyforge.llm.tokens import default_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the default quality policy keeps; a null text is rejected for its few words."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share."""
    counts = (fresh_name(docs, "n_lines"), fresh_name(docs, "n_dropped"))
    return linededup.dedup_lines(docs, counts=counts).select(*map(col, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return minhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, in shuffled shards."""
    return mixing.materialise(mixing.mix(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of the mix with its sequence and offset."""
    return packing.pack(docs, default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no byte-level BPE, so the pipeline is tested stage by stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; every result between is written in the shared folder, read
    again, and removed when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with workspace(spark):  # what the stage wrote on its way goes when its result is written
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
