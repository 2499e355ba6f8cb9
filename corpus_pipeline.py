"""The corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of documents. `run` writes each stage's rows as Parquet to the shared folder and
reads them again for the next; the rows of the stage before are then deleted.

Defined results: an empty table gives no rows; without labels of both kinds the classifiers answer alike for all
documents (a document of unknown quality stays, one of unknown toxicity too); null texts are scored as empty ones and
each is a document of its own to the near-duplicate stage; rows of equal id and text are one document after it; rows of
null id stay; further columns of documents are carried up to the tokens, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinscope.llm import bpe, mixing, near_dups, quality, toxicity
from twinscope.llm.common import discard, materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture wants it, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_clean),
    ("near duplicates", keep_one),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifiers, the alignment and the merges aren't SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
