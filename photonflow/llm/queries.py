"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photonflow.llm import bpe, chat, covertree, importance, lines, manifest, media, merkle, mixing, quality, rollup, simhash, warc
from photonflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": lambda spark, sf: quality.op1(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op2_lines": lambda spark, sf: lines.op2(table(spark, sf, "documents")),
        "op3_chat": lambda spark, sf: chat.op3(table(spark, sf, "conversations")),
        "op4_media": lambda spark, sf: media.op4(table(spark, sf, "documents")),
        "op5_warc": lambda spark, sf: warc.op5(table(spark, sf, "pages")),
        "op6_simhash": lambda spark, sf: simhash.op6(table(spark, sf, "documents")),
        "op7_merkle": lambda spark, sf: merkle.op7(table(spark, sf, "documents")),
        "op8_bpe": lambda spark, sf: bpe.op8(table(spark, sf, "documents")),
        "op9_rollup": lambda spark, sf: rollup.op9(table(spark, sf, "documents")),
        "op10_mixing": lambda spark, sf: mixing.op10(table(spark, sf, "documents")),
        "op11_covertree": lambda spark, sf: covertree.op11(table(spark, sf, "embeddings")),
        "op12_manifest": lambda spark, sf: manifest.op12(table(spark, sf, "documents")),
        "op13_importance": lambda spark, sf: importance.op13(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.ORACLE, "op5_warc": warc.ORACLE, "op11_covertree": covertree.ORACLE, "op12_manifest": manifest.ORACLE, "op13_importance": importance.ORACLE}
