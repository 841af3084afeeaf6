"""The training-data operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import ann, bpe, chat, isomedia, langid, linededup, minhash, packing, substring, warc
from ledgerloom.llm.common import run_dir, table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_conversations(table(spark, sf_dir, "conversations"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.digest_media(isomedia.store_texts(table(spark, sf_dir, "documents")))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "n_spread")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"), run_dir(spark, "warc"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clusters(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tool_calls, op2_substring_dedup, op3_byte_bpe, op4_media_columns, op5_nearest_neighbours, op6_language_id, op7_line_dedup, op8_warc, op9_best_fit_packing, op10_minhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_calls": chat.ORACLE, "op7_line_dedup": linededup.ORACLE, "op8_warc": warc.ORACLE}
