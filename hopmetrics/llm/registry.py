"""Queries of this subpackage and their SQL, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopmetrics.llm import (
    byte_bpe,
    chat,
    decontamination,
    embeddings_index,
    licenses,
    line_dedup,
    minhash,
    packing,
    repeats,
    sharding,
    toxicity,
    vector_codes,
    whitening,
)

QUERIES = {
    "op1_sharding": sharding,
    "op2_embeddings_index": embeddings_index,
    "op3_chat": chat,
    "op4_minhash": minhash,
    "op5_toxicity": toxicity,
    "op6_repeats": repeats,
    "op7_license_scan": licenses,
    "op8_decontamination": decontamination,
    "op9_packing": packing,
    "op10_line_dedup": line_dedup,
    "op11_byte_bpe": byte_bpe,
    "op12_vector_codes": vector_codes,
    "op13_whitening": whitening,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in QUERIES.items() if hasattr(module, "ORACLE")}
