"""The corpus pipeline (part of the llm operators): five stages over documents, each written and read again.

Each stage takes all rows that the one before kept. A row of null text passes the filters that need a text to reject it,
except language ID, which rejects texts without letters. An empty table stays empty. Extra columns stay up to the last
stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm import bpe, decontaminate, langid, ngram_join, toxicity
from textgate.llm.common import stored, table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < toxicity.THRESHOLD).select(docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identify(docs, langid.train(docs)).filter(~F.col("lang_rejected")).select(docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, *bpe.default_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean_of_toxicity),
    ("language_id", in_a_language),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]
ORACLE_SQL = None  # toxicity and language ID are trained models, which SQL can't express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
