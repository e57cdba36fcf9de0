"""TF-IDF keywords with smoothed idf ln((1+n)/(1+df)) + 1, over a bounded vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions.text import is_token, words
from citeloom.session import spread


def token_lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words) of each document; what is no token is left out when the lists are opened. Null texts have none."""
    return spread(df.select(key, text)).select(key, words(F.col(text)).alias("words"))


def _terms(lists: DataFrame, words: str | F.Column, *keep: str) -> DataFrame:
    # a plain explode would let the optimizer clean every text once more, in the scan, to see whether it has words
    return lists.select(*keep, F.explode_outer(words).alias("term")).where(is_token(F.col("term")))


def vocabulary(lists: DataFrame, n: int, min_df: int = 2, max_df: float = 0.95, size: int = 5000) -> DataFrame:
    """(term, df, cf): the `size` terms of highest corpus frequency in at least min_df and at most max_df of n documents.

    Ties go to the smaller term. Both counts come from one reading of the texts and combine on the map side; the result has
    at most `size` rows.
    """
    both = F.concat(F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))), F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d"))))
    seen = lists.select(F.explode_outer(both).alias("s")).where(is_token(F.col("s.term")))
    return _kept(seen.groupBy("s.term").agg(F.sum("s.d").alias("df"), F.sum("s.c").alias("cf")), n, min_df, max_df, size)


def _kept(counts: DataFrame, n: int, min_df: int, max_df: float, size: int) -> DataFrame:
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return kept.orderBy(F.desc("cf"), "term").limit(size)


def top_terms(lists: DataFrame, key: str, n: int, k: int = 3, min_df: int = 2, max_df: float = 0.95, size: int = 5000) -> DataFrame:
    """(key, rk, term, score): the k best terms, of the vocabulary that vocabulary() gives, of each document; ties go to the smaller term.

    Texts are read and shuffled once, as (document, term, count); the vocabulary comes from the same counts and is broadcast: it
    has at most `size` rows. Rows of one key are one document.
    """
    tf = _terms(lists, "words", key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = _kept(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), n, min_df, max_df, size)
    idf = vocab.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    scored = tf.join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= k).select(key, "rk", "term", F.round("score", 6).alias("score"))


def keywords(df: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """top_terms of every document of df; key is expected to be unique, repeated keys are one document."""
    lists = token_lists(df, key, text)
    n = df.count()
    return top_terms(lists, key, n, k)
