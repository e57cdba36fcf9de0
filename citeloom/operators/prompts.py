"""Cold-start recommendation: prompts to keywords to bags to a ranking of items, and what a ranking is shown with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import keyword_form
from citeloom.operators.recommend import bag_ranking
from citeloom.session import cut_lineage


def phrases(words: F.Column, most: int = 3) -> F.Column:
    """All runs of one to `most` of a list's words: what an extractor without a model may offer as keywords."""

    def runs(n: int) -> F.Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, most + 1)]))


def prompt_keywords(prompts: DataFrame, most: int = 3) -> DataFrame:
    """(prompt_id, keyword): the distinct phrases of each prompt (prompt_id, text). Null and blank prompts give no rows."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    return prompts.where("prompt_id is not null").select("prompt_id", words.alias("w")).select("prompt_id", F.explode(phrases(F.col("w"), most)).alias("keyword")).distinct()


def rank_prompts(keywords: DataFrame, bags: DataFrame, k: int = 5) -> DataFrame:
    """(prompt_id, rk, item_id, score): for each prompt the k items whose keyword bag is most like the prompt's known keywords.

    keywords: (prompt_id LONG, keyword); bags: (item_id, keyword, weight). Keywords in no bag are unknown and left out; a prompt
    of unknown ones only has a zero vector, scores 0.5 with every item and gets the smallest ids. A prompt without
    keywords gets no rows.
    """
    asked = cut_lineage(keywords.select("prompt_id", keyword_form(F.col("keyword")).alias("keyword")).where("keyword <> ''").distinct())
    known = asked.join(bags.select("keyword").distinct(), "keyword", "left_semi").select("prompt_id", "keyword", F.lit(1.0).alias("weight"))
    unknown = asked.select("prompt_id").distinct().join(known.select("prompt_id").distinct(), "prompt_id", "left_anti").select("prompt_id", F.lit("").alias("keyword"), F.lit(0.0).alias("weight"))
    return bag_ranking(known.unionAll(unknown).withColumnRenamed("prompt_id", "query_id"), bags, None, k).withColumnRenamed("query_id", "prompt_id")


def decorated(ranking: DataFrame, query: str, titles: DataFrame, authors: DataFrame, pool: DataFrame, item_keywords: DataFrame) -> DataFrame:
    """A ranking with what it is shown with: title, authors_str, score_percent and the matched keywords.

    ranking: (query, rk, item_id, score); titles: (item_id, title), authors: (item_id, authors_str), a row per item; pool: (query, keyword) of
    the queries, item_keywords: (item_id, keyword). Defaults stand where a title or author is missing; matches are in order,
    comma-separated, and empty for none.
    """
    matches = ranking.select(query, "item_id").join(item_keywords.distinct(), "item_id").join(pool.distinct(), [query, "keyword"], "left_semi")
    matches = matches.groupBy(query, "item_id").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ", ").alias("matches"))
    out = ranking.join(titles, "item_id", "left").join(authors, "item_id", "left").join(matches, [query, "item_id"], "left")
    return out.select(
        query, "rk", "item_id", "score", F.format_string("%.1f%%", F.round(F.col("score") * 100, 1)).alias("score_percent"), F.coalesce("title", F.lit("Title Not Found")).alias("title"),
        F.coalesce("authors_str", F.lit("Unknown Authors")).alias("authors_str"), F.coalesce("matches", F.lit("")).alias("matches"),
    )
