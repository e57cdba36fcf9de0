"""Token and cost accounting of language-model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cost_summary(calls: DataFrame, project_size: int | None, input_price: float = 0.15, output_price: float = 0.60) -> DataFrame:
    """One row of totals, averages per call, and tokens and cost projected to project_size calls; prices are per million tokens.

    calls: input_tokens, output_tokens; null tokens count as 0. No calls, or no project_size, give 0.0 throughout.
    """
    sums = calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"))
    avg_in = F.coalesce(F.try_divide("total_input_tokens", "calls"), F.lit(0.0)).cast("double")
    avg_out = F.coalesce(F.try_divide("total_output_tokens", "calls"), F.lit(0.0)).cast("double")
    size = F.lit(float(project_size or 0))
    cost_in, cost_out = avg_in * size / 1e6 * input_price, avg_out * size / 1e6 * output_price
    return sums.select(
        "calls", "total_input_tokens", "total_output_tokens", (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"),
        F.round(avg_in, 6).alias("avg_input_tokens"), F.round(avg_out, 6).alias("avg_output_tokens"),
        F.round(avg_in * size, 3).alias("projected_input_tokens"), F.round(avg_out * size, 3).alias("projected_output_tokens"),
        F.round(cost_in, 6).alias("projected_input_cost"), F.round(cost_out, 6).alias("projected_output_cost"), F.round(cost_in + cost_out, 6).alias("projected_cost"),
    )


def report_lines(summary: DataFrame) -> DataFrame:
    """(line_no, line): the summary as text, with commas in whole numbers and four places in costs. An empty summary gives no lines."""
    whole = lambda c: F.format_number(F.col(c).cast("long"), 0)
    dollars = lambda c: F.format_string("$%.4f", c)
    lines = [
        ("Calls", whole("calls")), ("Input tokens", whole("total_input_tokens")), ("Output tokens", whole("total_output_tokens")), ("All tokens", whole("total_tokens")),
        ("Projected input tokens", whole("projected_input_tokens")), ("Projected output tokens", whole("projected_output_tokens")),
        ("Projected input cost", dollars("projected_input_cost")), ("Projected output cost", dollars("projected_output_cost")), ("Projected cost", dollars("projected_cost")),
        ("Share of input in cost", F.format_string("%.2f%%", F.coalesce(F.try_divide("projected_input_cost", "projected_cost"), F.lit(0.0)) * 100)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).cast("long").alias("line_no"), F.concat(F.lit(f"{k + 1:02d} {name}: "), value).alias("line")) for k, (name, value) in enumerate(lines)]))
    return summary.select(each.alias("s")).select("s.line_no", "s.line")


def timing_summary(calls: DataFrame) -> DataFrame:
    """One row: calls, total_seconds, mean_seconds of calls with a duration `seconds`; a null mean for none."""
    known = calls.where(F.col("seconds").isNotNull())
    return known.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"), F.avg("seconds").alias("mean_seconds"))
