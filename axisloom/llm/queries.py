"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, media, passages, pieces, pii, quality, quotes, simhash, urls
from .common import table


def PIECES() -> str:
    """The SentencePiece model: AXISLOOM_PIECES, or that of the public tokenizers."""
    return os.environ.get("AXISLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.report(table(spark, sf_dir, "conversations"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"), pieces.Vocabulary.read(PIECES()))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 takes from rules alone."""
    return urls.parts(table(spark, sf_dir, "pages"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the payloads that op7 stores must be."""
    return media.payloads(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_quotes, op3_urls, op4_licenses, op5_simhash, op6_pieces, op7_media, op8_passages, op9_pii, op10_quality, pipeline, url_rules, media_payloads)
    return {f.__name__: f for f in found}
