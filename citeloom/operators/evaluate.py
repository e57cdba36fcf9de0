"""Label histograms and the evaluation of ranked label predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_histogram(rows: DataFrame, label: str) -> DataFrame:
    """(label, cnt) for every label from 0 to the largest, 0 for absent ones; null and negative labels are left out."""
    counts = rows.where(F.col(label) >= 0).groupBy(F.col(label).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    span = counts.agg(F.max("label").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("label"))
    return span.join(counts, "label", "left").select("label", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def label_summary(rows: DataFrame, label: str) -> DataFrame:
    """One row: n_labels, min_label, max_label."""
    return rows.agg(F.count_distinct(label).alias("n_labels"), F.min(label).cast("long").alias("min_label"), F.max(label).cast("long").alias("max_label"))


def hit_within(candidates: Column, truth: Column, k: int) -> Column:
    """Whether one of the first k candidates has the true label; false for null or empty lists."""
    return F.coalesce(F.exists(F.slice(candidates, 1, k), lambda c: F.coalesce(c["label_idx"] == truth, F.lit(False))), F.lit(False))


def scored(predictions: DataFrame) -> DataFrame:
    """(node_index, true_idx, pred_idx, top1, top3) of distinct records with a known true label.

    pred_idx is the first candidate's label, null for no candidates.
    """
    rows = predictions.where("true_label_idx is not null").select("node_index", "true_label_idx", F.col("topk_candidates").alias("c")).distinct()
    truth = F.col("true_label_idx")
    return rows.select("node_index", truth.cast("long").alias("true_idx"), F.try_element_at("c", F.lit(1))["label_idx"].cast("long").alias("pred_idx"), hit_within(F.col("c"), truth, 1).alias("top1"), hit_within(F.col("c"), truth, 3).alias("top3"))


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: n, top1_acc, top3_acc, n_miss, miss_rate; null rates for no records."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("top1").alias("a"), F.count_if("top3").alias("b"))
    return out.select("n", F.round(F.try_divide("a", "n"), 6).alias("top1_acc"), F.round(F.try_divide("b", "n"), 6).alias("top3_acc"), (F.col("n") - F.col("b")).alias("n_miss"), F.round(F.try_divide(F.col("n") - F.col("b"), "n"), 6).alias("miss_rate"))


def miss_confusion(rows: DataFrame, k: int = 20) -> DataFrame:
    """(true_idx, pred_idx, cnt): the k most frequent pairs of true and first predicted label among top-3 misses."""
    return rows.where("not top3").groupBy("true_idx", "pred_idx").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), F.asc_nulls_last("true_idx"), F.asc_nulls_last("pred_idx")).limit(k)


def per_class(rows: DataFrame) -> DataFrame:
    """(true_idx, total, miss, miss_rate)."""
    out = rows.groupBy("true_idx").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("top3")).alias("miss"))
    return out.withColumn("miss_rate", F.round(F.col("miss") / F.col("total"), 6))


def miss_examples(rows: DataFrame, k: int = 10) -> DataFrame:
    """(node_index, true_idx, pred_idx): the first k top-3 misses by node_index."""
    return rows.where("not top3").select("node_index", "true_idx", "pred_idx").orderBy("node_index", F.asc_nulls_last("true_idx"), F.asc_nulls_last("pred_idx")).limit(k)
