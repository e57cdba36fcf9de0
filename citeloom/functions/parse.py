"""Parsing of the JSON texts that outside services give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORK = "struct<ids:struct<mag:string>,authorships:array<struct<author:struct<display_name:string>>>>"
CANDIDATES = "array<struct<label_idx:string,category:string,reasoning:string>>"


def works(df: DataFrame, column: str) -> DataFrame:
    """(paper_id, authors) of works that have an id; null and empty display names are left out."""
    names = F.transform("w.authorships", lambda a: a["author"]["display_name"])
    parsed = df.select(F.from_json(column, WORK).alias("w")).where("w.ids.mag is not null")
    return parsed.select(F.col("w.ids.mag").alias("paper_id"), F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "")).alias("authors"))


def keyword_object(df: DataFrame, column: str) -> DataFrame:
    """df with domain, task and method of the JSON object in `column`; a missing or unreadable field is an empty array."""
    parsed = F.from_json(column, "struct<domain:array<string>,task:array<string>,method:array<string>>")
    empty = F.array().cast("array<string>")
    return df.withColumn("_k", parsed).withColumns({f: F.coalesce(F.col(f"_k.{f}"), empty) for f in ("domain", "task", "method")}).drop("_k")


def candidate_list(df: DataFrame, column: str) -> DataFrame:
    """df with `candidates` (label_idx INT, category, reasoning) of the object's `top_k` or else `candidates`; rows without a non-empty list are left out."""
    parsed = F.from_json(column, f"struct<top_k:{CANDIDATES},candidates:{CANDIDATES}>")
    out = df.withColumn("_c", parsed).withColumn("candidates", F.coalesce("_c.top_k", "_c.candidates")).where(F.size("candidates") > 0).drop("_c")
    return out.withColumn("candidates", F.transform("candidates", lambda c: F.struct(c["label_idx"].try_cast("int").alias("label_idx"), c["category"].alias("category"), c["reasoning"].alias("reasoning"))))


def usage(df: DataFrame, column: str) -> DataFrame:
    """df with input_tokens and output_tokens of the answer's `usage` block; what is missing or unreadable counts as 0."""
    parsed = F.from_json(column, "struct<usage:struct<prompt_tokens:string,completion_tokens:string>>")
    tokens = lambda name: F.coalesce(F.col(f"_u.usage.{name}").try_cast("long"), F.lit(0).cast("long"))
    return df.withColumn("_u", parsed).withColumns({"input_tokens": tokens("prompt_tokens"), "output_tokens": tokens("completion_tokens")}).drop("_u")


def keyword_list(printed: F.Column) -> F.Column:
    """The terms of a printed list, in single or double quotes; null and unreadable texts give an empty array."""
    return F.transform(F.regexp_extract_all(F.coalesce(printed, F.lit("")), F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))
