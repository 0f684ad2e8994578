"""Queries of the operators on tokens: byte-level BPE, packing, token counts. SQL can't express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_decode
from .common import table
from .packing import pack
from .token_counts import token_counts


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe, "op5_best_fit_packing": op5_best_fit_packing, "op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
