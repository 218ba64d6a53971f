"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, license_scan, line_dedup, neighbours, ngram_join, prefix_trie, quality, ranked_search, suffix_dedup, token_counts, toxicity
from .common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.duplicates(read(spark, sf_dir, "documents")).drop("uid")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = bpe.load_ranks(spark, P.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), ranks, P.PATTERN), ranks))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), list(bpe.load_ranks(spark, P.path("byte_bpe_50k.tiktoken"))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.examples(said.unionByName(more)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_join, op3_bpe, op4_license_scan, op5_token_counts, op6_quality_rules, op7_line_dedup, op8_suffix_dedup, op9_chat_format, op10_decontaminate, op11_multi_index, op12_prefix_trie, op13_ranked_search)}
ORACLES = {"op7_line_dedup": line_dedup.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
