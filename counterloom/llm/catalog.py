"""Queries of this package by name; each reads the whole tables under a folder."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from counterloom.llm.block_topk import top_products
from counterloom.llm.bpe import round_trip
from counterloom.llm.collocations import collocations
from counterloom.llm.hilbert import document_shards
from counterloom.llm.line_crf import line_quality
from counterloom.llm.minhash import jaccard_duplicates
from counterloom.llm.oracle import (
    COLLOCATIONS_SQL,
    JACCARD_SQL,
    PASSAGES_SQL,
    QUALITY_SQL,
    REVISITS_SQL,
    TOP_PRODUCTS_SQL,
    TRIE_SQL,
)
from counterloom.llm.packing import pack_documents
from counterloom.llm.prefix_trie import conversation_trie
from counterloom.llm.quality_rules import quality_rules
from counterloom.llm.simhash import near_duplicates
from counterloom.llm.suffix_dedup import passage_digests
from counterloom.llm.url_templates import judge_urls
from counterloom.llm.warc import resolve_revisits

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return document_shards(_table(spark, folder, "documents"), ["lang", "source", "n_chars"])


def op3_block_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(_table(spark, folder, "embeddings"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(
        _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_digests(_table(spark, folder, "documents"))


def op6_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op9_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_revisits(_table(spark, folder, "pages"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_duplicates(_table(spark, folder, "documents"), shingle=2)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_line_crf": op1_line_crf,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_block_topk": op3_block_topk,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_url_templates": op6_url_templates,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_minhash": op12_minhash,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op3_block_topk": TOP_PRODUCTS_SQL,
    "op5_suffix_dedup": PASSAGES_SQL,
    "op9_warc_revisits": REVISITS_SQL,
    "op10_quality_rules": QUALITY_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
    "op12_minhash": JACCARD_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
