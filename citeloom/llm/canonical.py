"""Mapping free-entered values to a reference list, by a prefix-filter set-similarity join.

A value is a set of features: the letter pairs of its words, each word framed by its start and end, so that word order,
case, punctuation and glued words in camel case don't matter. Features are ordered by rarity over both sides. Two
sets with Jaccard similarity t or more share a feature among the first |x| - ceil(t|x|) + 1 of each, so only
those prefixes are joined; a length and a positional filter prune, the whole sets verify, and the best entry is kept.
Distinct values are compared once, however many rows hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import checked_broadcast, cut_lineage

#: Jaccard similarity from which an entry is a candidate. One wrong letter in a word of 6 costs 3 of 7 pairs.
THRESHOLD = 0.4


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; camel case is split, other characters separate."""
    split = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features(ws: Column) -> Column:
    """The distinct letter pairs of framed words; linear in the words' length."""

    def pairs(w: Column) -> Column:
        chars = F.split(F.concat(F.lit("^"), w, F.lit("$")), "")
        return F.zip_with(F.slice(chars, 1, F.length(w) + 1), F.slice(chars, 2, F.length(w) + 1), lambda x, y: F.concat(x, y))

    return F.array_distinct(F.flatten(F.transform(ws, pairs)))


def _ordered(sets: DataFrame, df: DataFrame, threshold: float) -> DataFrame:
    """(id, features in order of rarity, size, prefix length)."""
    ranked = sets.select("id", F.explode("features").alias("f")).join(df, "f").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("s"))
    size = F.size("s")
    return ranked.select("id", F.transform("s", lambda x: x["f"]).alias("features"), size.alias("size"), (size - F.ceil(F.lit(threshold) * size) + 1).cast("int").alias("prefix"))


def _prefixes(ordered: DataFrame, side: str) -> DataFrame:
    return ordered.select(F.posexplode(F.slice("features", 1, F.col("prefix"))).alias("pos", "f"), F.col("id").alias(f"{side}_id"), F.col("size").alias(f"{side}_size")).withColumnRenamed("pos", f"{side}_pos")


def similarity_join(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of Jaccard similarity >= threshold: (left_id, right_id, jaccard).

    left and right: (id, features ARRAY<STRING> of distinct values), ids unique. Empty and null sets pair with nothing.
    """
    df = cut_lineage(left.select(F.explode("features").alias("f")).unionAll(right.select(F.explode("features").alias("f"))).groupBy("f").agg(F.count(F.lit(1)).alias("n")))
    df = checked_broadcast(df)
    x, y = cut_lineage(_ordered(left, df, threshold)), cut_lineage(_ordered(right, df, threshold))
    # the first shared feature has the least place on both sides
    met = _prefixes(x, "left").join(checked_broadcast(_prefixes(y, "right")), "f").where((F.col("right_size") >= F.lit(threshold) * F.col("left_size")) & (F.col("left_size") >= F.lit(threshold) * F.col("right_size")))
    met = met.groupBy("left_id", "right_id", "left_size", "right_size").agg(F.min("left_pos").alias("i"), F.min("right_pos").alias("j"))
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("left_size") + F.col("right_size")) - 1e-9)
    met = met.where(1 + F.least(F.col("left_size") - F.col("i") - 1, F.col("right_size") - F.col("j") - 1) >= least)
    whole = met.join(x.select(F.col("id").alias("left_id"), F.col("features").alias("a")), "left_id").join(checked_broadcast(y.select(F.col("id").alias("right_id"), F.col("features").alias("b"))), "right_id")
    shared = F.size(F.array_intersect("a", "b"))
    whole = whole.withColumn("jaccard", shared / (F.col("left_size") + F.col("right_size") - shared))
    return whole.where(F.col("jaccard") >= threshold - 1e-12).select("left_id", "right_id", "jaccard")


def _means(typed: Column, entry: Column) -> Column:
    """Whether every word of an entry stands in the typed words: as it is, cut short, or with some letters wrong; or both glued are nearly equal."""
    near = lambda r, w: (w == r) | ((F.length(w) >= 2) & F.startswith(r, w)) | (F.levenshtein(w, r) <= F.ceil(F.length(r) * 0.4))
    every = F.forall(entry, lambda r: F.exists(typed, lambda w: near(r, w)))
    a, b = F.array_join(typed, ""), F.array_join(entry, "")
    return every | (F.levenshtein(a, b) <= F.ceil(F.length(b) * 0.2))


def map_to_list(typed: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The entry that each typed value means: (value, label_idx, jaccard), null where none is similar enough.

    typed: (value STRING), repeated rows are one; null values are left out, blank ones unmatched. entries: (label_idx, form),
    any number of forms per label (names, codes); null forms are left out. Of several entries the most similar is kept, of
    equals the smallest label_idx. Very long values are sets like others. Empty lists leave everything unmatched.
    """
    values = typed.where(F.col("value").isNotNull()).select("value").distinct().withColumn("ws", words(F.col("value")))
    forms = entries.where(F.col("form").isNotNull()).select("label_idx", "form").distinct().withColumn("fs", words(F.col("form")))
    left = values.select(F.col("value").alias("id"), features(F.col("ws")).alias("features"))
    right = forms.select(F.struct("label_idx", "form").alias("id"), features(F.col("fs")).alias("features"))
    pairs = similarity_join(left, right, threshold)
    found = pairs.select(F.col("left_id").alias("value"), F.col("right_id.label_idx").alias("label_idx"), words(F.col("left_id")).alias("ws"), words(F.col("right_id.form")).alias("fs"), "jaccard").where(_means(F.col("ws"), F.col("fs")))
    best = found.groupBy("value").agg(F.max(F.struct("jaccard", (-F.col("label_idx")).alias("minus"))).alias("best"))
    return values.select("value").join(best, "value", "left").select("value", (-F.col("best.minus")).alias("label_idx"), F.col("best.jaccard").alias("jaccard"))


def canonical_candidates(predictions: DataFrame, categories: DataFrame) -> DataFrame:
    """(node_index, cand_no, category, label_idx) for the candidates whose category isn't exactly a listed one.

    predictions: node_index, topk_candidates. categories: label_idx, category, short_code. label_idx is that of the
    entry the text names, -1 for none; for a null or blank text it is the candidate's own if listed, else -1. Null and
    empty candidate lists give no rows; repeated rows of a node count once (of differing ones the least is taken).
    """
    rows = predictions.select("node_index", F.posexplode("topk_candidates").alias("pos", "c")).groupBy("node_index", (F.col("pos") + 1).alias("cand_no")).agg(F.min(F.struct(F.col("c.category").alias("category"), F.col("c.label_idx").alias("own"))).alias("s")).select("node_index", "cand_no", "s.category", "s.own")
    listed = checked_broadcast(categories.select("category").where(F.col("category").isNotNull()).distinct())
    rows = cut_lineage(rows.join(listed, "category", "left_anti"))
    forms = categories.select("label_idx", F.explode(F.array("category", "short_code")).alias("form"))
    mapped = map_to_list(rows.select(F.col("category").alias("value")), forms)
    own = checked_broadcast(categories.select(F.col("label_idx").alias("own"), F.lit(True).alias("is_listed")).distinct())
    blank = F.col("category").isNull() | ~F.col("category").rlike(r"[^\p{IsWhite_Space}]")
    out = rows.join(mapped, rows["category"] == mapped["value"], "left").join(own, "own", "left")
    label = F.when(blank, F.when(F.col("is_listed"), F.col("own"))).otherwise(F.col("label_idx"))
    return out.select("node_index", "cand_no", "category", F.coalesce(label, F.lit(-1)).cast("int").alias("label_idx"))
