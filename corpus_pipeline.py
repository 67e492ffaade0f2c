"""The corpus pipeline: five stages over ``documents``, each an operator of its own.

language: documents of no language go, and so do those whose language is
likelier wrong than right (a score below ``LEAST_SCORE``: other languages than
those learned, strings that are no prose). near_duplicates: one document of each
group of near copies stays, the one of the least doc_id. substrings: words of
windows that also start in a document with a smaller doc_id go, and a document
with none left. decontaminate: spans that occur in ``benchmark`` go, and a
document with none left. packing: the rest is packed into sequences of 2048
tokens. All but the last return the columns of ``documents``, with n_chars
brought up to date.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontaminate, jaccard, langid, packing, substrings
from framelake.llm._scratch import Scratch


#: Score of a language, 0 to 1, that a document must reach.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.clean(docs, langid.learn(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.clean(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.clean(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_substrings),
    ("decontaminate", benchmark),
    ("packing", pack),
]

#: Language models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark), None
    for _, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before, docs = after, after.df
    return docs
