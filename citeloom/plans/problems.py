"""Queries p4_ and p5_ over the project's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import keyed, references
from citeloom.sources.catalog import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "final_user_interactions", "user_id", "item_id")
    profiles = keyed.profile(keyed.compress_both(rows, "user_id", "item_id"), ["key_field", "key"])
    return keyed.heavy_keys(profiles, rows.count()).select("key_field", F.col("key").alias("key_value"))


def p4_key_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "final_user_interactions", "user_id", "item_id")
    profiles = keyed.profile(keyed.compress_both(rows, "user_id", "item_id"), ["key_field", "key"])
    return profiles.withColumnRenamed("key", "key_value")


def _lag(df: DataFrame) -> DataFrame:
    return df.withColumn("lag_s", F.unix_timestamp("loaded_at") - F.unix_timestamp("created_at"))


def p4_user_lag(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lag(table(spark, folder, "final_user_interactions", "user_id", "created_at", "loaded_at"))
    out = keyed.percentiles(keyed.compress(rows, "user_id", "lag_s"), {"lag_p50": 0.5, "lag_p90": 0.9})
    return out.withColumnRenamed("key", "user_id")


def p4_item_lag(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lag(table(spark, folder, "final_user_interactions", "item_id", "created_at", "loaded_at"))
    out = keyed.percentiles(keyed.compress(rows, "item_id", "lag_s"), {"lag_p50": 0.5, "lag_p90": 0.9})
    return out.withColumnRenamed("key", "item_id")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "nodeidx2paperid", "node_idx", "paper_id", "added_at", "removed_at")
    return references.orphan_references(
        [
            ("final_user_interactions", 0, table(spark, folder, "final_user_interactions", "item_id", "loaded_at").select(F.col("item_id").alias("key"), F.col("loaded_at").alias("at"))),
            ("llm_extraction_results", 0, table(spark, folder, "llm_extraction_results", "node_idx", "loaded_at").select(F.col("node_idx").alias("key"), F.col("loaded_at").alias("at"))),
            ("titleabs", 1, table(spark, folder, "titleabs", "paper_id", "loaded_at").select(references.number_key("paper_id").alias("key"), F.col("loaded_at").alias("at"))),
        ],
        [nodes.select(F.col("node_idx").alias("key"), "added_at", "removed_at"), nodes.select(references.number_key("paper_id").alias("key"), "added_at", "removed_at")],
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "load_month", F.col("key").cast("string").alias("ref_key"), "reason")


def p5_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, folder))


def _profile_sql(heavy: bool) -> str:
    one = """SELECT '{k}' AS key_field, {k} AS key_value, count(*) AS n_rows, count(DISTINCT {v}) AS n_distinct FROM final_user_interactions GROUP BY {k}"""
    both = " UNION ALL ".join(one.format(k=k, v=v) for k, v in (("user_id", "item_id"), ("item_id", "user_id")))
    if heavy:
        return f"SELECT key_field, key_value FROM ({both}) WHERE key_value IS NOT NULL AND n_rows * 100 >= (SELECT count(*) FROM final_user_interactions)"
    mode = """SELECT '{k}' AS key_field, {k} AS key_value, {v} AS mode_value, count(*) AS mode_rows FROM final_user_interactions WHERE {v} IS NOT NULL
        GROUP BY {k}, {v} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {v}) = 1"""
    modes = " UNION ALL ".join(f"SELECT * FROM ({mode.format(k=k, v=v)})" for k, v in (("user_id", "item_id"), ("item_id", "user_id")))
    return f"SELECT p.key_field, p.key_value, n_rows, n_distinct, mode_value, coalesce(mode_rows, 0) AS mode_rows FROM ({both}) p LEFT JOIN ({modes}) m ON p.key_field = m.key_field AND p.key_value IS NOT DISTINCT FROM m.key_value"


def _lag_sql(key: str) -> str:
    return f"""WITH r AS (SELECT {key}, CAST(epoch(date_trunc('second', loaded_at)) - epoch(date_trunc('second', created_at)) AS BIGINT) AS lag_s FROM final_user_interactions),
    o AS (SELECT {key}, lag_s, row_number() OVER (PARTITION BY {key} ORDER BY lag_s) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM r WHERE lag_s IS NOT NULL)
    SELECT {key}, min(lag_s) FILTER (WHERE i >= ceil(0.5 * n)) AS lag_p50, min(lag_s) FILTER (WHERE i >= ceil(0.9 * n)) AS lag_p90 FROM o GROUP BY {key}"""


_NUMBER = "CAST(CAST(trim(paper_id) AS DECIMAL(38,10)) AS BIGINT)"
_ORPHANS = f"""
WITH nodes AS (SELECT node_idx, {_NUMBER} AS paper, added_at, removed_at FROM nodeidx2paperid),
refs AS (
  SELECT 'final_user_interactions' AS table_name, item_id AS key, loaded_at AS seen FROM final_user_interactions
  UNION ALL SELECT 'llm_extraction_results', node_idx, loaded_at FROM llm_extraction_results
  UNION ALL SELECT 'titleabs', {_NUMBER}, loaded_at FROM titleabs),
d AS (SELECT DISTINCT * FROM refs WHERE key IS NOT NULL AND seen IS NOT NULL),
states AS (
  SELECT d.table_name, d.key, d.seen, count(n.k) AS known, coalesce(bool_or(n.added_at <= d.seen AND (n.removed_at IS NULL OR d.seen < n.removed_at)), false) AS live, coalesce(bool_or(n.removed_at <= d.seen), false) AS gone
  FROM d LEFT JOIN (SELECT 'n' AS s, node_idx AS k, added_at, removed_at FROM nodes UNION ALL SELECT 'p', paper, added_at, removed_at FROM nodes) n
  ON n.k = d.key AND n.s = CASE WHEN d.table_name = 'titleabs' THEN 'p' ELSE 'n' END GROUP BY ALL),
cases AS (
  SELECT DISTINCT table_name, strftime(seen, '%Y-%m') AS load_month, CAST(key AS VARCHAR) AS ref_key, CASE WHEN known = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS reason
  FROM states WHERE NOT live)
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_key_profile, p4_user_lag, p4_item_lag, p5_found, p5_orphan_report)}
SQL = {
    "p4_found": _profile_sql(True),
    "p4_key_profile": _profile_sql(False),
    "p4_user_lag": _lag_sql("user_id"),
    "p4_item_lag": _lag_sql("item_id"),
    "p5_found": _ORPHANS + "SELECT table_name, load_month, ref_key, reason FROM cases",
    "p5_orphan_report": _ORPHANS + "SELECT table_name, load_month, reason, count(*) AS n_keys FROM cases GROUP BY ALL",
}
