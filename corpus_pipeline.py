"""A document corpus made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents,
and returns what it keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm import langid, linededup, mixing, packing, simhash
from pointspark.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or without a letter go."""
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    out, (pred, _) = langid.identify(docs, profiles)
    return out.where(F.col(pred) != "und").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; those that had nothing else go."""
    out, (_, dropped) = linededup.dedup_lines(docs)
    emptied = (F.col(dropped) > 0) & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == "")
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in training order, sources by weight."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, as pieces of documents with their ids."""
    return packing.pack(docs, with_ids=True, order=stored_order(docs))


def stored_order(docs: DataFrame) -> tuple:
    """Where each row stands in the files that hold docs: the mix writes its parts in training order. Empty for a table without files."""
    try:
        place = docs.metadataColumn("_metadata")
    except AnalysisException:
        return ()
    name = place["file_name"]
    return F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long"), name, place["row_index"]


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes, profiles, tokens and components have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
