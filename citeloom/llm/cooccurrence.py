"""Pairs of items that occur in the same record, by large-basket blocking.

A basket of more than CHUNK items is split into chunks by a hash of the item, and each pair of chunks is a row of its
own: the products of one huge basket are spread over many tasks. A chunk of a huge basket has CHUNK / 2 items on average, however
large the basket is; an ordinary basket is one chunk paired with itself. Items are numbers while they are paired; pair
counts combine on the map side before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut_lineage

CHUNK = 64


def item_counts(items: DataFrame) -> DataFrame:
    """(field_name, item, n_records) over distinct (field_name, record, item) rows."""
    return items.groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("n_records"))


def chunk_pairs(items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per pair of items of a basket: (a, b), a < b. items: distinct (record, id), id a number; records are told apart by whatever type."""
    sizes = items.groupBy("record").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    chunks = F.when(F.col("size") <= chunk, 1).otherwise(F.ceil(F.col("size") * 2 / chunk)).cast("int")
    parts = items.join(sizes, "record").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    lists = parts.groupBy("record", "chunks", "chunk").agg(F.collect_list("id").alias("ids"))
    # an ordinary basket meets itself; a chunk of a huge one goes to every pair of chunks it belongs to
    ordinary = lists.where("chunks = 1").select(F.col("ids").alias("left"), F.col("ids").alias("right"))
    sides = lists.where("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    lo, hi = F.least("chunk", "other"), F.greatest("chunk", "other")
    first = F.first(F.when(F.col("chunk") == F.least("chunk", "other"), F.col("ids")), ignorenulls=True).alias("left")
    second = F.first(F.when(F.col("chunk") == F.greatest("chunk", "other"), F.col("ids")), ignorenulls=True).alias("right")
    huge = sides.groupBy("record", lo.alias("lo"), hi.alias("hi")).agg(first, second)
    # within one chunk each pair is made once, as a < b; between two chunks in whichever order is a < b
    once = ordinary.unionAll(huge.where("lo = hi").select("left", "right")).select(F.explode("left").alias("a"), "right").select("a", F.explode(F.filter("right", lambda b: b > F.col("a"))).alias("b"))
    crossed = huge.where("lo < hi and left is not null and right is not null").select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y"))
    return once.unionAll(crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def pair_statistics(items: DataFrame, totals: DataFrame, min_shared: int = 1, min_lift: int | None = None) -> DataFrame:
    """(field_name, item_a, item_b, shared, count_a, count_b, n, lift) for the pairs that share at least min_shared records.

    items: (field_name, record, item), repeated rows count once, null items and records not at all. totals: (field_name,
    n), the number of records. lift is n * shared / (count_a * count_b), 1 at chance. With min_lift, only pairs with
    n * shared >= min_lift * count_a * count_b, in whole numbers. item_a < item_b by code point. A record with one
    item has no pair; empty tables give no rows.

    Two prunings keep the result whole: an item in fewer than min_shared records is in no pair asked for, and
    since shared <= min(count_a, count_b), neither is one with min_lift * count > n.
    """
    once = cut_lineage(items.where(F.col("item").isNotNull() & F.col("record").isNotNull()).select("field_name", "record", "item").distinct())
    counts = item_counts(once).join(F.broadcast(totals), "field_name").where(F.col("n_records") >= min_shared)
    if min_lift:
        counts = counts.where(F.col("n_records") * min_lift <= F.col("n"))
    counts = cut_lineage(counts.withColumn("id", F.monotonically_increasing_id()))
    kept = once.join(counts.select("field_name", "item", "id"), ["field_name", "item"]).select(F.struct("field_name", "record").alias("record"), "id")
    pairs = chunk_pairs(kept).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    for end in ("a", "b"):
        side = counts.select(F.col("id").alias(end), F.col("item").alias(f"item_{end}"), F.col("n_records").alias(f"count_{end}"), *(["field_name", "n"] if end == "a" else []))
        pairs = pairs.join(side, end)
    if min_lift:
        pairs = pairs.where(F.col("n").cast("decimal(38,0)") * F.col("shared") >= F.col("count_a").cast("decimal(38,0)") * F.col("count_b") * min_lift)
    swap = F.col("item_a") > F.col("item_b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    out = pairs.select("field_name", either("item_a", "item_b").alias("item_a"), either("item_b", "item_a").alias("item_b"), "shared", either("count_a", "count_b").alias("count_a"), either("count_b", "count_a").alias("count_b"), "n")
    return out.withColumn("lift", F.col("n") * F.col("shared") / (F.col("count_a") * F.col("count_b")).cast("double"))
