"""The thin queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelyard.llm import cross_polytope, decontamination, filter_audit, lexical_search, quality_rules, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.html_text import main_text

    return main_text(_read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.decontamination import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.quality_rules import verdicts

    return verdicts(_read(spark, sf_dir, "documents")).drop("class_distance", "common_distance")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.toxicity import scores

    return scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.warc import archived

    return archived(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.suffix_dedup import removals

    return removals(_read(spark, sf_dir, "documents")).drop("starts", "ends")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.packing import best_fit_packing

    return best_fit_packing(_read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.quality_classifier import scores

    return scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(_read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_html_text, op3_decontamination, op4_quality_rules, op5_toxicity, op6_warc, op7_suffix_dedup, op8_packing, op9_quality_classifier, op10_simhash, op11_vector_copies, op12_filter_audit, op13_lexical_search)}
SQL: dict[str, str] = {"op3_decontamination": decontamination.SQL, "op4_quality_rules": quality_rules.SQL, "op6_warc": warc.SQL, "op11_vector_copies": cross_polytope.SQL, "op12_filter_audit": filter_audit.SQL, "op13_lexical_search": lexical_search.SQL}
