"""A training-data pipeline: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  The filters
return `docs` with its own columns; extra columns pass through.  Empty tables give empty results
(models without training rows: quality rejects nothing, language rejects all).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import langid, packing, quality, shingles, simhash
from strandweave.llm.common import read_table, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, accepts."""
    return quality.accepted(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from these documents; unsure ones and those without letters go."""
    return langid.accepted(docs, langid.fit(docs))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more link."""
    return simhash.keep_one(docs, shingles.near_duplicates(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_copies),
    ("packing", pack_windows),
]

#: Models, fingerprints and tokens aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
