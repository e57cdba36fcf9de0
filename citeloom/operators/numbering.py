"""Dense numbers in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut_lineage, shuffle_width


def cardinalities(df: DataFrame, *columns: str) -> DataFrame:
    """(column_name, cardinality): the largest id and one more, the size of a table indexed by that column; 0 where there is no id."""
    sizes = df.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).cast("long").alias(c) for c in columns])
    return sizes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cardinality")) for c in columns])).alias("s")).select("s.column_name", "s.cardinality")


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with `name`, start, start + 1, ... in order of the columns `order`, which must tell all rows apart.

    Rows are sorted by range partition; the partitions' row counts, one number each, give every partition's offset.
    Nulls come first. An empty table stays empty.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.select("*", F.monotonically_increasing_id().alias("_at")))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, at = [], start
    for p, n in counts:
        offsets.append((p, at))
        at += n
    offsets = spark.createDataFrame(offsets, "_part long, _offset long")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + place).drop("_part", "_offset", "_at")
