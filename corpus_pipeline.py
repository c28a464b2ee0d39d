"""The corpus pipeline: quality classifier, near-duplicate join, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; the last returns
per document what the written token files hold. Side tables (labels, benchmark) come from sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import forest_jaccard, kneser_ney_quality, suffix_decontamination, wavelet_tokens, weighted_mixing
from assayer.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like the trusted ones; texts without words go."""
    return kneser_ney_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of every class of near duplicates."""
    return forest_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return suffix_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return weighted_mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending id order; per document its place, length and checksum read from them."""
    # Its workers go on to other stages: they remember fewer chunks, for some more time.
    return wavelet_tokens.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=200_000)


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing to target weights", mixing), ("token ids", tokens)]

#: Kneser-Ney perplexities and the forest join are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
