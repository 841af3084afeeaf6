"""A corpus pipeline: language ID, line dedup, near-dedup, substring dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next stage's documents. All stages but the last return the
columns of ``documents``; each works on all its predecessor kept.

Rows: what each operator does with nulls, empty and long texts, repeated rows and
empty tables is told in its module; a document with a null text is rejected by the
first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, linededup, minhash, packing, substring
from ledgerloom.llm.common import fresh, run_dir
from ledgerloom.session import ship_package

#: Least posterior probability of a language for a document to stay.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or no language with most of the probability."""
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    lang, score = fresh("lang_pred", docs), fresh("score", docs)
    named = langid.predict(docs, model, lang, score).where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return named.select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand on many sites."""
    return linededup.remove_boilerplate(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that an earlier document has."""
    return substring.remove_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token sequences."""
    return packing.pack(packing.pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship_package(spark), docs, sf_dir)


STAGES = [(f.__name__, _shipped(f)) for f in (language_id, line_dedup, near_dedup, substring_dedup, best_fit_packing)]

#: Segmentation sums, signatures and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
