"""Corpus pipeline: documents to shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and reread as the
next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import language_id
from voxlake.llm.decontaminate import drop_contaminated
from voxlake.llm.mixing import mixed_documents
from voxlake.llm.ngram_jaccard import keep_one_of_each
from voxlake.llm.scratch import Scratch
from voxlake.llm.sharding import with_shards
from voxlake.session import ship

#: A document stays if one language has this share of its letters.
LANGUAGE_SHARE = 0.5
#: Near-duplicates: words of a shingle, and the similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
#: No source is repeated more often, and none loses a document.
MAX_REPEATS = 2.0
SHARDS = 16


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts in no one language; learned from the documents' own labels."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.learn(docs), LANGUAGE_SHARE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates."""
    ship(spark)
    return keep_one_of_each(docs, SHINGLE, SIMILAR, 100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources towards the flattest mix within the repetition limit."""
    ship(spark)
    return mixed_documents(docs, max_repeats=MAX_REPEATS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``shard`` and ``slot``."""
    ship(spark)
    return with_shards(docs, SHARDS)


STAGES = [("language", identify), ("jaccard", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Language labels have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
