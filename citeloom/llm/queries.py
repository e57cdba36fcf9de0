"""The queries of this package's problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import canonical, contamination, cooccurrence, mixing, names, sentences, term_frequency
from citeloom.llm.text import term, trimmed
from citeloom.sources.catalog import table


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "llm_extraction_results", "node_idx", "domain", "task", "method")
    return term_frequency.term_frequencies(rows, "node_idx", ["domain", "task", "method"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p1_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder)


def _pairs(spark: SparkSession, folder: str, **bounds: int) -> DataFrame:
    authors = table(spark, folder, "author_data_openalex", "node_idx", "authors")
    methods = table(spark, folder, "llm_extraction_results", "node_idx", "method")
    items = authors.select(F.lit("authors").alias("field_name"), F.col("node_idx").alias("record"), F.explode("authors").alias("item")).withColumn("item", trimmed(F.col("item")))
    items = items.unionAll(methods.select(F.lit("method").alias("field_name"), F.col("node_idx").alias("record"), F.explode("method").alias("item")).withColumn("item", term(F.col("item"))))
    totals = authors.select(F.lit("authors").alias("field_name"), "node_idx").unionAll(methods.select(F.lit("method").alias("field_name"), "node_idx"))
    totals = totals.where(F.col("node_idx").isNotNull()).distinct().groupBy("field_name").agg(F.count(F.lit(1)).alias("n"))
    return cooccurrence.pair_statistics(items, totals, **bounds)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, min_shared=5, min_lift=3).select("field_name", "item_a", "item_b")


def p2_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).drop("n")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _canonical(spark, folder).select("node_index", "cand_no", "label_idx")


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    rows = _canonical(spark, folder).where("label_idx = -1")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_candidates"))


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_candidates(table(spark, folder, "topic_prediction_results", "node_index", "topk_candidates"), table(spark, folder, "labelidx2category", "label_idx", "category", "short_code"))


def _spellings(spark: SparkSession, folder: str) -> DataFrame:
    authors = table(spark, folder, "author_data_openalex", "authors").select(F.explode("authors").alias("name"))
    return authors.unionAll(table(spark, folder, "final_user_profiles", "author_name").select(F.col("author_name").alias("name")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.spelling_pairs(_spellings(spark, folder))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_spellings(_spellings(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_mix_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_seats(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.seats(table(spark, folder, "mix_targets"), table(spark, folder, "documents", "source"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_term_counts, p2_found, p2_pair_counts, p3_found, p3_unmatched, p6_found, p6_entities, p7_found, p7_leaked_items, p8_mix, p8_mix_report, p8_seats, p9_found)}
