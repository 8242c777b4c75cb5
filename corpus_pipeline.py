"""A corpus pipeline: reject, deduplicate, mix, pack. Counted as part of ``chronokey.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronokey.llm import mixing, ngram_join, packing, quality
from chronokey.llm.common import keep, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least 0.3, learnt from the labelled ones among them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: sets of five-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their length bucket and token-budget batch."""
    return packing.pack(docs)


STAGES = [("quality classifier", good), ("n-gram Jaccard join", distinct), ("mixing sources", mixed), ("packing", packed)]

#: SQL can't express the classifier's fit; tests hold the other stages against a brute-force version each,
#: and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
