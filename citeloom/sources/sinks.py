"""Writers: JSON, CSV, maps, checkpoints that append by id, and a side output for errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def keyword_map(df: DataFrame, path: str) -> None:
    """(paper_id, keywords) as JSON lines of one-entry objects: a map in parts, so that none is collected."""
    df.select(F.to_json(F.create_map("paper_id", "keywords")).alias("value")).write.mode("overwrite").text(path)


def interactions_csv(df: DataFrame, path: str) -> None:
    """Interactions with their keyword lists as JSON text."""
    keywords = F.to_json("keywords") if dict(df.dtypes)["keywords"].startswith("array") else F.col("keywords")
    df.select("user_id", "item_id", "paper_id", keywords.alias("keywords")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def split_by_status(df: DataFrame, good: str, bad: str) -> None:
    """Successful rows appended to `good`, the others, with node_idx, error and status, written to `bad` anew."""
    df.where("status = 'success'").drop("error").write.mode("append").parquet(good)
    df.where("status <> 'success'").select("node_idx", "error", "status").write.mode("overwrite").parquet(bad)


def stamped(path: str, run_id: str) -> str:
    """A path of its own for a run, so that earlier results stay."""
    return f"{path.rstrip('/')}/run_id={run_id}"


def sample(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def cost_report(summary: DataFrame, records: DataFrame, path: str) -> None:
    """A report folder: the one-row summary and the call records, each as JSON lines; records stay distributed."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    records.write.mode("overwrite").json(f"{path}/records")
