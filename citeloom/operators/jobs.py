"""The composed keyword-extraction job: what is pending, calls, answers by status, costs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import parse
from citeloom.operators.cost import cost_summary
from citeloom.session import cut_lineage
from citeloom.sources.providers import CallPolicy, call_all
from citeloom.streaming.enrich import pending


@dataclass
class JobResult:
    """results: successful rows with domain, task, method and tokens; errors: node_idx, error, status; missing: node_idx without
    a text; costs: the one-row summary of the successful calls."""

    results: DataFrame
    errors: DataFrame
    missing: DataFrame
    costs: DataFrame


def keyword_job(texts: DataFrame, done: DataFrame, provider: Callable[[str], tuple[str, int, int]], policy: CallPolicy = CallPolicy(), project_size: int | None = None, limit: int | None = None) -> JobResult:
    """Extract keywords for every text (node_idx, text) whose node_idx isn't in done (node_idx).

    Calls are made once and written down. With limit, only the first texts by node_idx are asked: a trial, or the costing
    mode, whose summary is projected to project_size calls. Null, empty and blank texts are reported as missing and
    cost no call. A fatal answer ends the task's calls; what wasn't called is in no table and stays pending. Repeated rows of
    a node_idx are one request, with the greatest text. Nothing pending gives empty tables and a summary of zeros.
    """
    wanted = pending(texts.groupBy("node_idx").agg(F.max("text").alias("text")), done, "node_idx")
    if limit is not None:
        wanted = wanted.orderBy("node_idx").limit(limit)
    wanted = cut_lineage(wanted)
    has_text = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    answers = cut_lineage(call_all(wanted, provider, policy))
    good = parse.keyword_object(answers.where("status = 'success'"), "body")
    results = good.select("node_idx", "domain", "task", "method", "input_tokens", "output_tokens", "status")
    errors = answers.where("status <> 'success'").select("node_idx", "error", "status")
    return JobResult(results, errors, wanted.where(~has_text).select("node_idx"), cost_summary(results, project_size))


def by_status(job: JobResult) -> DataFrame:
    """(node_idx, status, input_tokens, output_tokens) of every node of the job, missing ones included."""
    none = F.lit(0).cast("long")
    return (
        job.results.select("node_idx", "status", "input_tokens", "output_tokens")
        .unionAll(job.errors.select("node_idx", "status", none, none))
        .unionAll(job.missing.select("node_idx", F.lit("missing"), none, none))
    )
