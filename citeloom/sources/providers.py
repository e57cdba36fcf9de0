"""Calls to outside services by pluggable providers, several at a time per task; the default ones work offline."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from citeloom.operators.numbering import dense_ids

#: Calls of a task that are handed to its threads at a time, for each of them.
ROUNDS = 16
RESULT = "node_idx long, body string, input_tokens long, output_tokens long, status string, error string, seconds double"


@dataclass(frozen=True)
class CallPolicy:
    """How calls are made: tasks, calls at a time in a task, attempts, and seconds before and between them."""

    tasks: int = 4
    at_once: int = 4
    attempts: int = 10
    before: float = 0.0
    wait: float = 0.0
    wait_more: float = 0.0


#: Presets of a small and a large account.
SMALL = CallPolicy(tasks=1, at_once=3, wait=3.0)
LARGE = CallPolicy(tasks=10, at_once=5, wait=5.0, wait_more=2.0)


def offline_keywords(text: str) -> tuple[str, int, int]:
    """A stand-in for a language model: the text's longest words, as domain, task and method; the same for the same text."""
    words = sorted({w.lower() for w in text.split() if w.isalpha()}, key=lambda w: (-len(w), w))
    body = {"domain": words[:2], "task": words[2:4], "method": words[4:7]}
    return json.dumps(body), len(text) // 4, len(json.dumps(body)) // 4


def offline_lengths(text: str) -> tuple[str, int, int]:
    """A stand-in that answers with no keywords and counts four letters of the text as an input token, sixteen as an output token."""
    return json.dumps({"domain": [], "task": [], "method": []}), len(text) // 4, len(text) // 16


def offline_label(n_labels: int) -> Callable[[str], tuple[str, int, int]]:
    """A stand-in for a classifier: three labels from the first 32 bits of the text's MD5, at no tokens."""

    def call(text: str) -> tuple[str, int, int]:
        h = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        return json.dumps({"top_k": [{"label_idx": (h + 7 * i) % n_labels, "reasoning": None} for i in range(3)]}), 0, 0

    return call


def unreliable(provider: Callable[[str], tuple[str, int, int]], fatal: str | None = None) -> Callable[[str], tuple[str, int, int]]:
    """A provider that fails for texts whose MD5 begins with 0, and of whose quota nothing is left for those that begin with `fatal`."""

    def call(text: str) -> tuple[str, int, int]:
        digest = hashlib.md5(text.encode()).hexdigest()
        if fatal is not None and digest.startswith(fatal):
            raise RuntimeError("insufficient_quota")
        if digest.startswith("0"):
            raise RuntimeError("no answer")
        return provider(text)

    return call


def call_all(requests: DataFrame, provider: Callable[[str], tuple[str, int, int]], policy: CallPolicy = CallPolicy()) -> DataFrame:
    """(node_idx, body, input_tokens, output_tokens, status, error, seconds) of every request (node_idx, text), in no order.

    status is success, failed after `attempts` errors, or fatal for an error that names an insufficient quota; failed calls
    have no tokens. Null, empty and blank texts make no call and no row. A fatal answer ends the calls of its task: those under way
    finish, and what is left is in no row. With one task and one call at a time, requests are made in order of node_idx.
    """

    def one(idx: int, text: str) -> tuple:
        error, began = "", time.time()
        for attempt in range(policy.attempts):
            if policy.before:
                time.sleep(policy.before)
            try:
                return (idx, *provider(text), "success", None, time.time() - began)
            except Exception as e:  # noqa: BLE001  a provider may raise anything
                error = str(e)
                if "insufficient_quota" in error:
                    return idx, None, 0, 0, "fatal", error, time.time() - began
                if attempt + 1 < policy.attempts:
                    time.sleep(policy.wait + policy.wait_more * attempt)
        return idx, None, 0, 0, "failed", error, time.time() - began

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(policy.at_once) as pool:
            for batch in batches:
                rows, over = [], False
                asked = list(zip(batch["node_idx"], batch["text"]))
                step = policy.at_once * ROUNDS if policy.at_once > 1 else 1
                for begin in range(0, len(asked), step):
                    jobs = [pool.submit(one, i, t) for i, t in asked[begin : begin + step]]
                    for job in as_completed(jobs):
                        if not job.cancelled():
                            rows.append(job.result())
                            if rows[-1][4] == "fatal" and not over:
                                over = True
                                for other in jobs:
                                    other.cancel()
                    if over:
                        break
                yield pd.DataFrame(rows, columns=["node_idx", "body", "input_tokens", "output_tokens", "status", "error", "seconds"])
                if over:
                    return

    wanted = requests.select("node_idx", "text").where(F.col("text").rlike(r"\S"))
    return wanted.repartition(policy.tasks).sortWithinPartitions("node_idx").mapInPandas(work, RESULT)


def observed(answers: DataFrame, name: str = "calls") -> tuple[DataFrame, Observation]:
    """answers with an observation of its progress: after an action, observation.get has calls, succeeded and tokens."""
    watch = Observation(name)
    tokens = F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))
    return answers.observe(watch, F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "success").alias("succeeded"), tokens.alias("tokens")), watch


def joined_ids(ids: DataFrame, batch: int = 40) -> DataFrame:
    """(batch_no, ids): distinct non-blank paper ids, trimmed, in order, `batch` at a time, joined by "|" for a filter."""
    clean = ids.select(F.trim("paper_id").alias("paper_id")).where("paper_id <> ''").distinct()
    numbered = dense_ids(clean, ["paper_id"], "n")
    return numbered.groupBy(F.floor(F.col("n") / batch).alias("batch_no")).agg(F.array_join(F.array_sort(F.collect_list("paper_id")), "|").alias("ids"))


def works_client(base: str, open_url: Callable | None = None, timeout: float = 20.0) -> Callable[[list[str]], list[str]]:
    """A client of a bibliographic service for fetch_works: one request for all ids, joined by "|" in a filter, of the ids and authorships only.

    open_url(url, timeout=...) gives a response with `status` and read(), urllib's by default. An answer other than 200 or no
    answer within the timeout raises, so that the ids asked for have no authors.
    """

    def client(ids: list[str]) -> list[str]:
        import urllib.parse
        import urllib.request

        query = urllib.parse.urlencode({"filter": "ids.mag:" + "|".join(ids), "select": "ids,authorships", "per-page": len(ids)})
        with (open_url or urllib.request.urlopen)(f"{base}?{query}", timeout=timeout) as answer:
            if answer.status != 200:
                raise OSError(f"status {answer.status}")
            return [json.dumps(work) for work in json.loads(answer.read()).get("results", [])]

    return client


def fetch_works(ids: DataFrame, client: Callable[[list[str]], list[str]], batch: int = 40, pause: float = 0.0) -> DataFrame:
    """(paper_id, authors) of every id: the client gets up to `batch` ids and gives JSON texts of works; ids it doesn't answer, or fails on, have no authors."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                try:
                    bodies = client(frame["paper_id"].iloc[at : at + batch].tolist())
                except Exception:  # noqa: BLE001
                    bodies = []
                if pause:
                    time.sleep(pause)
                yield pd.DataFrame({"body": pd.Series(bodies, dtype=object)})

    from citeloom.functions.parse import works

    asked = ids.select(F.trim("paper_id").alias("paper_id")).where("paper_id <> ''").distinct()
    found = works(asked.mapInPandas(work, "body string"), "body").groupBy("paper_id").agg(F.max("authors").alias("authors"))
    return asked.join(found, "paper_id", "left").select("paper_id", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"))
