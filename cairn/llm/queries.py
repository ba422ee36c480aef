"""The registered queries of the subpackage: each operator on its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import convtrie, crosspoly, decontam, langid, lshforest, mixing, ordminhash, pii, quality, spelling, substring, suffix, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"))
    pages = langid.page_evidence(table(spark, sf_dir, "pages")).select("page_id", "page_text", "page_host", "page_domain", "page_suffix", "page_declared")
    found = langid.identify(pages, model, text="page_text", host="page_host", domain="page_domain", suffix="page_suffix", declared="page_declared")
    return found.select("page_id", "page_host", "page_declared", "lang_text", "lang_id", "lang_posterior", "lang_accepted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.search(table(spark, sf_dir, "embeddings"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.interleave(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "block", "slot", "mix_pos", "on_target")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordminhash.classify(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_bundles(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality, op3_prefix_forest, op4_pfair_mix, op5_substring_dedup, op6_pii, op7_decontaminate, op8_suffix_array_dedup, op9_order_minhash, op10_warc, op11_spelling_variants, op12_cross_polytope, op13_conversation_trie)}


def oracles() -> dict[str, str]:
    return {"op4_pfair_mix": mixing.ORACLE, "op5_substring_dedup": substring.ORACLE, "op7_decontaminate": decontam.ORACLE, "op8_suffix_array_dedup": suffix.ORACLE, "op10_warc": warc.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_cross_polytope": crosspoly.ORACLE, "op13_conversation_trie": convtrie.ORACLE}
