"""The corpus pipeline: documents less the toxic, the unidentifiable and the near copies, mixed and encoded.

Nulls, empty texts, repeated rows and ties: the toxic and the near-copy stages keep null and empty texts, the
language stage drops them, as they are in no language; rows with a null id are kept as documents of their
own; of rows that share an id one is left after the near copies.  An empty table stays empty throughout, and
extra columns pass through, but for any named as an output of the encoding, which replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm.bpe import bpe_encode
from loam.llm.common import cut, table
from loam.llm.jaccard import keep_one_of_each
from loam.llm.language import keep_known
from loam.llm.mixing import keep_mixed
from loam.llm.toxicity import keep_mild


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity under the threshold; the model is fitted on the labelled ones."""
    return keep_mild(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of the tokens."""
    return keep_mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return bpe_encode(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]
#: SQL can express neither the fitted models nor the encoding; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, cut after those whose rows the next one reads more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name not in ("mixing", "encoding"):
            docs = cut(docs)
    return docs
