"""The queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from deskloom.llm import chat, codes, exact_dedup, lexical, quality, topk, url_filter
from deskloom.llm.bpe import bpe_digests
from deskloom.llm.html_text import extract_text
from deskloom.llm.language import predict_languages
from deskloom.llm.mixing import mix_sources
from deskloom.llm.ngram_join import ngram_components
from deskloom.llm.shared import documents
from deskloom.llm.warc import archive_pages

#: The vocabulary of op3 and the pipeline.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations as linked, ordered and validated calls of a tool."""
    calls, results = chat.conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.link_tool_calls(calls, results, chat.REPLY)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source to weights of 5, 2 and 1 in turn."""
    return mix_sources(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' token ids and of the texts decoded from them."""
    return bpe_digests(documents(spark, sf_dir), VOCABULARY)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 90 % of their 3-word shingles, directly or over others."""
    return ngram_components(documents(spark, sf_dir), n=3, num=90, den=100)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    return predict_languages(documents(spark, sf_dir))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id", "text")


def op7_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for each fiftieth one, by inner product."""
    vectors = topk.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.norm_topk(vectors, vectors.where("vec_id % 50 = 0"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by four rules and a list of spam URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(pages, url_filter.spam_list(pages))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, read back and merged into capture histories."""
    merged = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "range", "position")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of the quality rules on all documents."""
    return quality.quality_rules(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item, of all documents."""
    return lexical.lexical_search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as codes of 16 parts, with their errors."""
    return codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the one of their equal texts that stays."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_chat_format, op2_mix_sources, op3_bpe, op4_ngram_join, op5_language_id, op6_html_text, op7_norm_topk, op8_url_filter, op9_warc, op10_quality_rules, op11_lexical_search, op12_vector_codes, op13_exact_dedup)
}
#: SQL of those that SQL can express.
ORACLE: dict[str, str] = {"op1_chat_format": chat.ORACLE, "op8_url_filter": url_filter.ORACLE, "op10_quality_rules": quality.quality_sql(), "op11_lexical_search": lexical.ORACLE, "op12_vector_codes": codes.codes_sql(), "op13_exact_dedup": exact_dedup.ORACLE}
