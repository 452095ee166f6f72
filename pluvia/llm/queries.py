"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import ann, bpe, embed, langid, lm, lz, minhash, mixing, quality, repair, secrets, warc
from .sql import SQL as ORACLE

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """A file of the installed vocabularies; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, root: str) -> DataFrame:
    return langid.identify(table(spark, root, "documents"))


def op2_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.histories(table(spark, root, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_dedup(spark: SparkSession, root: str) -> DataFrame:
    return embed.near_duplicates(table(spark, root, "embeddings"))


def op4_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"))


def op5_lm(spark: SparkSession, root: str) -> DataFrame:
    return lm.evaluate(table(spark, root, "documents"))


def op6_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.digests(table(spark, root, "documents"), tokenizer())


def op7_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.classify(table(spark, root, "documents"), table(spark, root, "labels"))


def op8_secrets(spark: SparkSession, root: str) -> DataFrame:
    return secrets.scan(table(spark, root, "documents"))


def op9_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return ann.search(table(spark, root, "embeddings"))


def op10_minhash(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, root, "documents"))


def op11_repair(spark: SparkSession, root: str) -> DataFrame:
    return repair.digests(repair.damaged(table(spark, root, "conversations")))


def op12_lz(spark: SparkSession, root: str) -> DataFrame:
    return lz.neighbours(table(spark, root, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language, op2_warc, op3_embedding_dedup, op4_mixing, op5_lm, op6_bpe, op7_quality, op8_secrets, op9_neighbours, op10_minhash, op11_repair, op12_lz)}

__all__ = ["ORACLE", "QUERIES"]
