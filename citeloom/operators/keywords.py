"""Keyword vocabularies and weighted keyword bags of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import keyword_form
from citeloom.operators.numbering import dense_ids

#: How often a keyword of each field counts in an item's bag.
WEIGHTS = {"domain": 2, "task": 1, "method": 1}


def field_keywords(items: DataFrame, key: str = "node_idx", fields: tuple[str, ...] = ("domain", "task", "method")) -> DataFrame:
    """Distinct (item_id, field, keyword), trimmed and lower-cased; null keys, null arrays, null and blank terms are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in fields])).alias("s")
    long = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), each).select("item_id", "s.field", F.explode("s.terms").alias("t"))
    return long.select("item_id", "field", keyword_form(F.col("t")).alias("keyword")).where("keyword <> ''").distinct()


def first_positions(items: DataFrame, key: str = "node_idx", fields: tuple[str, ...] = ("domain", "task", "method")) -> DataFrame:
    """(item_id, keyword, pos): each item's distinct keywords with the place where they first stand, fields in order."""
    each = F.explode(F.array(*[F.struct(F.lit(no).alias("no"), F.col(f).alias("terms")) for no, f in enumerate(fields)])).alias("s")
    long = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), each).select("item_id", "s.no", F.posexplode("s.terms").alias("at", "t"))
    rows = long.select("item_id", keyword_form(F.col("t")).alias("keyword"), (F.col("no").cast("long") * (1 << 32) + F.col("at")).alias("pos"))
    return rows.where("keyword <> ''").groupBy("item_id", "keyword").agg(F.min("pos").alias("pos"))


def vocabulary(keywords: DataFrame) -> DataFrame:
    """(keyword, keyword_id): ids from 1 in the keywords' order; 0 stands for no keyword."""
    return dense_ids(keywords.select("keyword").distinct(), ["keyword"], "keyword_id", 1).select("keyword", "keyword_id")


def weighted_bags(keywords: DataFrame, vocab: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """(item_id, keyword_id, weight): field weights summed per keyword; keywords beyond the vocabulary are dropped."""
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in weights.items()], F.lit(1))
    return keywords.join(vocab, "keyword").groupBy("item_id", "keyword_id").agg(F.sum(weight).alias("weight"))


def overlap(pairs: DataFrame, user_keywords: DataFrame, item_keywords: DataFrame) -> DataFrame:
    """(user_id, item_id, n_overlap): distinct keywords that a user's pool and an item share, 0 if none.

    pairs: distinct (user_id, item_id); user_keywords: (user_id, keyword); item_keywords: (item_id, keyword).
    """
    pool = user_keywords.distinct()
    shared = pairs.join(item_keywords.select("item_id", "keyword").distinct(), "item_id").join(pool, ["user_id", "keyword"], "left_semi").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n_overlap"))
    return pairs.join(shared, ["user_id", "item_id"], "left").select("user_id", "item_id", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))
