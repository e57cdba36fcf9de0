"""Per-key results when a few keys hold most rows, by value-frequency compression.

Rows are grouped by (key, value) before they are grouped by key. The first grouping combines on
the map side, so a hot key leaves each task as its distinct values with weights, spread over all
tasks by value; what is left to do per key is algebraic (counts, sums, best value) and combines
on the map side too. Exact percentiles come from the weights, bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.session import checked_broadcast, cut_lineage


def compress(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """(key, value, weight): how often each value stands beside each key.

    Null keys and null values are kept as groups of their own. An empty table gives an empty one.
    Other columns, whatever their names, are dropped.
    """
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def compress_both(df: DataFrame, first: str, second: str) -> DataFrame:
    """compress() for first by second and for second by first, over one shuffle of the rows.

    The two columns must have one type. Gives (key_field, key, value, weight).
    """
    pairs = df.select(F.col(first).alias("a"), F.col(second).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    both = F.explode(F.array(
        F.struct(F.lit(first).alias("key_field"), F.col("a").alias("key"), F.col("b").alias("value")),
        F.struct(F.lit(second).alias("key_field"), F.col("b").alias("key"), F.col("a").alias("value")),
    ))
    return pairs.select(both.alias("s"), "weight").select("s.key_field", "s.key", "s.value", "weight")


def profile(compressed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, distinct values, mode and the mode's rows of each key, from compressed rows.

    n_rows counts every row, those with a null value included; n_distinct and mode leave nulls out.
    Of several equally frequent values the smallest is the mode; a key with null values only has a
    null mode with 0 rows. The null key is a key like any other.
    """
    by = by or ["key"]
    best = F.max(F.when(F.col("value").isNotNull(), F.struct(F.col("weight"), (-F.col("value")).alias("minus"))))
    return (
        compressed.groupBy(*by)
        .agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct"), best.alias("best"))
        .select(*by, "n_rows", "n_distinct", (-F.col("best.minus")).alias("mode_value"), F.coalesce("best.weight", F.lit(0)).alias("mode_rows"))
    )


def _place(cuts: Column, value: Column) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(cuts, lambda c: c < value))


def percentiles(compressed: DataFrame, shares: dict[str, float], buckets: int = 64, range_rows: int = 1_000_000) -> DataFrame:
    """Exact nearest-rank percentiles of each key's non-null values, from compressed rows.

    The percentile p of n values is the smallest value whose rank is at least ceil(p * n). Values are cut
    into ranges at approximate quantiles of the whole table (at most `buckets` numbers, whatever the data);
    per key the ranges' weights tell in which range each rank lies, and only those ranges go on. One that still has more than
    range_rows distinct values of a key is cut again, at that key's own quantiles, until none has; there are at most as
    many such ranges as range_rows goes into the table. What is left is put in order, range by range. So no task
    orders more than range_rows values of a hot key. Cuts change speed, not results. Keys without a non-null value give no row.
    """
    rows = cut_lineage(compressed.where(F.col("value").isNotNull()).select("key", "value", "weight"))
    at = ", ".join(str((i + 1) / buckets) for i in range(buckets - 1))
    quantiles = F.expr(f"percentile_approx(value, array({at}), 1000)")
    cuts = sorted(set(rows.agg(quantiles.alias("c")).first()["c"] or []))
    rows = rows.withColumn("bucket", _place(F.array(*[F.lit(c) for c in cuts]), F.col("value")) if cuts else F.lit(0))

    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = rows.groupBy("key", "bucket").agg(F.sum("weight").alias("w")).withColumn("upto", F.sum("w").over(upto)).withColumn("n", F.sum("w").over(Window.partitionBy("key")))
    rank = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).alias("rank")) for name, p in shares.items()])).alias("s")
    wanted = ranges.select("key", "bucket", (F.col("upto") - F.col("w")).alias("before"), "upto", rank).select("key", "bucket", "before", "upto", "s.name", "s.rank")
    wanted = wanted.where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).withColumnRenamed("key", "k").withColumnRenamed("bucket", "b")
    # rows of the wanted ranges only; (key, name) tells the ranges apart
    inside = cut_lineage(rows.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("b"))).select("key", "name", "rank", "before", "value", "weight"))

    done = None
    while True:
        large = cut_lineage(inside.groupBy("key", "name").agg(F.count(F.lit(1)).alias("c"), quantiles.alias("cuts")).where(F.col("c") > range_rows).select(F.col("key").alias("k"), F.col("name").alias("m"), "cuts"))
        if large.limit(1).count() == 0:
            break
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("name") == F.col("m"))
        small = inside.join(checked_broadcast(large.select("k", "m")), same, "left_anti")
        done = small if done is None else done.unionAll(small)
        cut = inside.join(checked_broadcast(large), same).withColumn("bucket", _place(F.col("cuts"), F.col("value"))).drop("k", "m", "cuts")
        upto = Window.partitionBy("key", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = cut.groupBy("key", "name", "rank", "before", "bucket").agg(F.sum("weight").alias("w")).withColumn("upto", F.col("before") + F.sum("w").over(upto))
        parts = parts.where((F.col("upto") - F.col("w") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select(F.col("key").alias("k"), F.col("name").alias("m"), F.col("bucket").alias("b"), (F.col("upto") - F.col("w")).alias("now"))
        inside = cut_lineage(cut.join(checked_broadcast(parts), same & (F.col("bucket") == F.col("b"))).select("key", "name", "rank", F.col("now").alias("before"), "value", "weight"))
    inside = inside if done is None else done.unionAll(inside)

    order = Window.partitionBy("key", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = inside.withColumn("run", F.col("before") + F.sum("weight").over(order))
    hit = run.where((F.col("run") >= F.col("rank")) & (F.col("run") - F.col("weight") < F.col("rank")))
    return hit.groupBy("key").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares])


def heavy_keys(profiles: DataFrame, total_rows: int, one_in: int = 100) -> DataFrame:
    """The non-null keys that hold at least one in `one_in` of total_rows, in whole numbers."""
    return profiles.where(F.col("key").isNotNull() & (F.col("n_rows") * one_in >= F.lit(total_rows)))
