"""Queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamcube.llm import chunk_dedup, decontam, hilbert_ann, html_text, license_scan, mixing, phrases, simhash, suffix_dedup, token_count, toxicity, url_filter, vector_codes
from loamcube.llm._shared import materialize, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category and the verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, chain)
    found = [c for c in out.columns if c.startswith("tx_") and c != "tx_is_toxic"]
    return out.select("doc_id", *(F.col(c).alias(f"p_{c[3:]}") for c in found), F.col("tx_is_toxic").alias("toxic"))


def op2_hilbert_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hilbert_ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("ht_text").alias("text"), F.col("ht_n_chars").alias("n_chars"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_count.count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", *(F.col(f"tk_{c}").alias(c) for c in ("n_bytes", "n_tokens", "over_limit")))


def op7_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that stand in other places too, and what is left when the first of each kind stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = chunk_dedup.remove_repeated_chunks(docs, want_text=False)
    return out.select("doc_id", *(F.col(f"cd_{c}").alias(c) for c in ("n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, want_text=False)
    return out.select("doc_id", *(F.col(f"sd_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("ls_n_known").alias("n_sentences"), F.col("ls_ids").alias("sentence_ids"), F.col("ls_licenses").alias("licenses"), (F.col("ls_licenses") != "").alias("has_license"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.scan_documents(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", *(F.col(f"dc_{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark))
    return out.select("page_id", *(F.col(f"uf_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    codebooks = vector_codes.fit(vectors)
    coded = materialize(vector_codes.encode(vectors, codebooks).drop("embedding"), "vector-codes")
    out = vector_codes.with_label_errors(coded)
    return out.select("vec_id", *(F.col(f"vq_{c}").alias(c) for c in ("code", "error", "label_error")), F.lit(vector_codes.codebooks_sha256(codebooks)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_hilbert_nearest_neighbours": op2_hilbert_nearest_neighbours,
    "op3_html_extraction": op3_html_extraction,
    "op4_source_mixing": op4_source_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_content_defined_chunks": op7_content_defined_chunks,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op4_source_mixing": mixing.oracle_sql(),
    "op8_suffix_array_dedup": suffix_dedup.oracle_sql(),
    "op9_license_scan": license_scan.oracle_sql(),
    "op10_benchmark_decontamination": decontam.oracle_sql(),
    "op11_phrase_collocations": phrases.oracle_sql(),
    "op12_url_filter": url_filter.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
