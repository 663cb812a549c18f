"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, extract, hmm, language, lines, media, mixing, multiset, packing, quality, simhash, trie, urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _on_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm_scoring": _on_documents(hmm.op1),
        "op2_byte_cnn_quality": lambda spark, sf_dir: quality.op2(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op3_line_template_dedup": _on_documents(lines.op3),
        "op4_url_temporal_lists": lambda spark, sf_dir: urls.op4(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op5_source_mixing": _on_documents(mixing.op5),
        "op6_bin_slack_packing": _on_documents(packing.op6),
        "op7_language_bitmask_filters": _on_documents(language.op7),
        "op8_simhash_components": _on_documents(simhash.op8),
        "op9_multiset_fingerprints": _on_documents(multiset.op9),
        "op10_media_chunk_store": _on_documents(media.op10),
        "op11_tag_path_extraction": lambda spark, sf_dir: extract.op11(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op12_exponion_codes": lambda spark, sf_dir: codes.op12(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op13_conversation_trie": lambda spark, sf_dir: trie.op13(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_temporal_lists": urls.ORACLE, "op11_tag_path_extraction": extract.ORACLE, "op12_exponion_codes": codes.ORACLE, "op13_conversation_trie": trie.ORACLE}
