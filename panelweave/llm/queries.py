"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, cobucket, dedup, ngram_join, packing, pii, quality, sharding, token_counts, token_files, toxicity, warc, whitening
from .common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": lambda s, d: pii.report(documents(s, d)),
        "op2_bpe": lambda s, d: bpe.report(documents(s, d), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "op3_token_counts": token_counts.report,
        "op4_quality": lambda s, d: quality.report(documents(s, d)),
        "op5_sharding": lambda s, d: sharding.assign(documents(s, d)),
        "op6_toxicity": lambda s, d: toxicity.report(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op7_exact_dedup": lambda s, d: dedup.report(documents(s, d)),
        "op8_warc": lambda s, d: warc.report(s.read.parquet(f"{d}/pages.parquet")),
        "op9_ngram_join": lambda s, d: ngram_join.with_components(documents(s, d), 4, 85),
        "op10_packing": lambda s, d: packing.pack(documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
        "op11_whitening": lambda s, d: whitening.report(s.read.parquet(f"{d}/embeddings.parquet")),
        "op12_token_files": lambda s, d: token_files.report(documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
        "op13_cobucket": lambda s, d: cobucket.report(s.read.parquet(f"{d}/sales.parquet"), s.read.parquet(f"{d}/sale_lines.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_token_counts": token_counts.SQL, "op4_quality": quality.SQL, "op7_exact_dedup": dedup.SQL}
