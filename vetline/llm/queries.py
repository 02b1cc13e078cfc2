"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vetline.llm import (bpe, conversations, decontaminate, merkle, neardup, packing, passages, quality, sharding, tokenfile,
                         toolcalls, urlfilter, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_repeated_passages": passages.op2_repeated_passages,
    "op3_token_shards": tokenfile.op3_token_shards,
    "op4_sharding": sharding.op4_sharding,
    "op5_url_filter": urlfilter.op5_url_filter,
    "op6_warc": warc.op6_warc,
    "op7_tool_calls": toolcalls.op7_tool_calls,
    "op8_minhash_neardup": neardup.op8_minhash_neardup,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": sharding.op4_sql(),
    "op7_tool_calls": toolcalls.OP7_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
