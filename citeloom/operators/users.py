"""Users from authors: registry, interactions, keyword profiles, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.operators.numbering import dense_ids


def author_rows(papers: DataFrame) -> DataFrame:
    """(node_idx, pos, author_name) of distinct (node_idx, authors) rows; blank and null names and null nodes are left out.

    A name that a paper lists twice is two rows.
    """
    rows = papers.select("node_idx", "authors").where(F.col("node_idx").isNotNull()).distinct()
    return rows.select("node_idx", F.posexplode("authors").alias("pos", "author_name")).withColumn("author_name", F.trim("author_name")).where("author_name <> ''")


def registry(authors: DataFrame) -> DataFrame:
    """(user_id, author_name): users numbered from 0 in order of their first (node_idx, pos). Namesakes are one user."""
    first = authors.groupBy("author_name").agg(F.min(F.struct("node_idx", "pos")).alias("first"))
    ids = dense_ids(first.select("author_name", "first.node_idx", "first.pos"), ["node_idx", "pos", "author_name"], "user_id")
    return ids.select("user_id", "author_name")


def interactions(authors: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, item_id, n): how often each user stands on each paper."""
    return authors.join(users, "author_name").groupBy("user_id", F.col("node_idx").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))


def top_keywords(pairs: DataFrame, item_keywords: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, rk, keyword, cnt): the k most frequent keywords of each user's papers; ties go to the one that comes first, by paper and place in it, then to
    the smaller.

    pairs: (user_id, item_id, n); item_keywords: distinct (item_id, keyword), with the keyword's place `pos` in the paper, if known.
    """
    place = F.col("pos") if "pos" in item_keywords.columns else F.lit(0)
    rows = pairs.join(item_keywords.select("item_id", "keyword", place.alias("pos")), "item_id")
    counts = rows.groupBy("user_id", "keyword").agg(F.sum("n").alias("cnt"), F.min(F.struct("item_id", "pos")).alias("first"))
    order = Window.partitionBy("user_id").orderBy(F.desc("cnt"), "first", "keyword")
    return counts.withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= k).select("user_id", "rk", "keyword", "cnt")


def counts_per_user(rows: DataFrame, min_count: int = 1) -> DataFrame:
    """(user_id, cnt) of users with at least min_count rows; the null user is left out."""
    return rows.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)


def heavy_users(rows: DataFrame, min_count: int) -> DataFrame:
    """counts_per_user, or all users with their counts if none reaches min_count."""
    counts = counts_per_user(rows)
    heavy = counts.where(F.col("cnt") >= min_count)
    return heavy if heavy.limit(1).count() else counts


def interaction_stats(rows: DataFrame) -> DataFrame:
    """One row: n_users, n_interactions, mean_per_user, over rows with a user; null mean for none."""
    known = rows.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return known.agg(F.count(F.lit(1)).alias("n_users"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_interactions")).withColumn("mean_per_user", F.round(F.try_divide("n_interactions", "n_users"), 6))


def coverage(papers: DataFrame) -> DataFrame:
    """One row: total distinct nodes, found (with an author), found_ratio; a null ratio for no nodes."""
    per_node = papers.where(F.col("node_idx").isNotNull()).groupBy("node_idx").agg(F.max(F.coalesce(F.size(F.filter("authors", lambda a: F.trim(a) != "")) > 0, F.lit(False))).alias("found"))
    return per_node.agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("found")).withColumn("found_ratio", F.round(F.try_divide("found", "total"), 6))


def first_and_last(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, first_value, last_value): the value of the first and of the last row of each key, in `order`, then by value; null keys and values are left out."""
    at = F.struct(*order, value)
    rows = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.min(at)[value].alias("first_value"), F.max(at)[value].alias("last_value"))
