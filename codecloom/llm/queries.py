"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecloom.llm.collocations import collocations
from codecloom.llm.common import table
from codecloom.llm.exact_dedup import exact_groups
from codecloom.llm.language_id import identify
from codecloom.llm.line_dedup import line_dedup
from codecloom.llm.mixing import mixed_order
from codecloom.llm.packing import pack_documents
from codecloom.llm.quote_links import threaded_conversations
from codecloom.llm.simhash import near_duplicates
from codecloom.llm.suffix_dedup import suffix_dedup
from codecloom.llm.token_files import read_documents, write_token_files
from codecloom.llm.topk import exact_top_k
from codecloom.llm.toxicity import toxicity
from codecloom.llm.whitening import whiten
from codecloom.session import shared_path


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threaded_conversations(table(spark, sf_dir, "conversations"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixed_order(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_documents(spark, folder)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("first_doc", "first_word")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quote_links": op1_quote_links,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_topk_search": op7_topk_search,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
