"""Mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks.

The mix is a number of blocks of BLOCK tokens. Blocks go to the sources by the highest quotients share / (2k + 1), a
source being out once its blocks, repeated max_repeats times, are used up; a source's blocks go to its shards in the
same way, by the shards' tokens. Documents of a shard stand in a seeded order, end to end, and are cut into blocks of BLOCK
tokens, so that a block is the end of one document, whole ones and the beginning of another. A quota of q of a shard's b
blocks takes every block q // b times and q % b blocks, drawn by seed, once more. So every choice is made shard by shard,
and a source misses its quota by no more than the last, shorter blocks of its shards.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm.text import squeezed
from citeloom.session import cut_lineage, spread

BLOCK = 256
#: Tokens of a shard, and shards that are apportioned at once.
SHARD_TOKENS = 2_000_000
FAN = 1000


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2k + 1), none beyond its cap; ties go to the earlier.

    Fewer seats are given than asked for only if all caps are reached.
    """
    w, cap = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    cap = np.where(w > 0, cap, 0)
    if cap.sum() <= seats:
        return cap.tolist()
    rounded = lambda d: np.minimum(cap, np.floor(w / d + 0.5)).astype(np.int64)
    low, high = w[w > 0].min() / (cap.max() + 1) / 4, 2 * w.max() + 1
    for _ in range(200):  # the largest divisor's side: never more than the seats
        mid = (low + high) / 2
        low, high = (mid, high) if rounded(mid).sum() > seats else (low, mid)
    got = rounded(high)
    quotients = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < cap[i]]
    heapq.heapify(quotients)
    for _ in range(int(seats - got.sum())):
        _, i = heapq.heappop(quotients)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(quotients, (-w[i] / (2 * got[i] + 1), i))
    return got.tolist()


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """The columns `keep` and n_tokens, the tokens of the whole text; 0 for a null or empty one. tokenizer: a rank file's path."""
    import public_tokenizers

    path, pattern = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(str(path), pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.pop("_text")]
            yield batch.assign(n_tokens=np.array(n, dtype="int64"))

    rows = spread(df.select(*keep, F.col(text).alias("_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(count, f"{schema}, n_tokens long")


def source_key(column: str) -> F.Column:
    return F.lower(squeezed(F.col(column)))


def _apportion(df: DataFrame, by: list[str], total: str, schema: str) -> DataFrame:
    """Gives each row its part, quota, of its group's `total`, by tokens and cap; rows in order of `part`."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        group["quota"] = sainte_lague(group["tokens"].tolist(), group["cap"].tolist(), int(group[total].iloc[0]))
        return group.drop(columns=[total])

    return df.groupBy(*by).applyInPandas(one, schema)


def listed_sources(targets: DataFrame) -> list:
    """(source, target_share, max_repeats) of the list, by source. Of rows that repeat a source the least counts; null sources are none. Beyond 100,000 sources an error is raised."""
    wanted = targets.select(source_key("source").alias("source"), F.struct("target_share", F.col("max_repeats").cast("long").alias("max_repeats")).alias("s")).where(F.col("source").isNotNull())
    rows = wanted.groupBy("source").agg(F.min("s").alias("s")).select("source", "s.target_share", "s.max_repeats").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 sources")
    return sorted(rows, key=lambda r: r["source"])


def _picker(seed: int, block: int):
    """Of one shard: the pieces of its documents in the blocks that the quota draws."""

    def pick(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["place", "doc_id"])
        n = shard["n_tokens"].to_numpy(dtype=np.int64)
        ends = np.cumsum(n)
        starts, blocks = ends - n, int(-(-ends[-1] // block))
        rounds, more = divmod(int(shard["quota"].iloc[0]), blocks)
        times = np.full(blocks, rounds, dtype=np.int64)
        source, number = shard["source"].iloc[0], int(shard["shard"].iloc[0])
        times[np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(source.encode()), number]).permutation(blocks)[:more]] += 1
        first, last = starts // block, (ends - 1) // block
        count = last - first + 1
        doc = np.repeat(np.arange(len(n)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        begin, end = np.maximum(starts[doc], at * block), np.minimum(ends[doc], (at + 1) * block)
        out = pd.DataFrame({"doc_id": shard["doc_id"].to_numpy()[doc], "source": source, "shard": number, "block": at, "start_token": begin - starts[doc], "n_tokens": end - begin, "times": times[at]})
        return out[out["times"] > 0]

    return pick


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The training mix and its report.

    documents: doc_id (unique), text, source; targets: source, target_share, max_repeats (a short list). Sources are compared
    squeezed and lower-cased. total_tokens: the mix's size, by default the tokens of all listed sources' documents.
    The mix: (doc_id, source, shard, block, start_token, n_tokens, times): the n_tokens tokens of the document from
    start_token (from 0) on stand in that block of the shard, which is used times >= 1 times. The report, a row per listed
    source: n_documents, available_tokens, quota_tokens, used_tokens, over_tokens (used less quota), target_share,
    reached_share, missed_share (target less reached).

    What a source can't fill at max_repeats goes to the others in proportion to their shares; its shortfall is in the
    report. Documents with null or empty text have no tokens and aren't drawn; those of sources that aren't listed, or
    null, aren't either. A listed source without documents reaches 0. Empty documents give an empty mix and a report of zeros.
    The list is taken to the driver; it is a list of sources, checked to have at most 100,000. A shard, about shard_tokens
    tokens or one longer document, is picked from by one task.
    """
    spark = documents.sparkSession
    rows = listed_sources(targets)
    wanted = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    docs = documents.select("doc_id", "text", source_key("source").alias("source")).join(F.broadcast(wanted), "source")
    sized = cut_lineage(count_tokens(docs, "text", ["doc_id", "source"], tokenizer).where("n_tokens > 0"))
    have = {r["source"]: (r["n"], r["tokens"]) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    total = total_tokens if total_tokens is not None else sum(t for _, t in have.values())

    # shards, and groups of at most FAN of them, so that each apportionment has a bounded list
    size = [(r["source"], max(0, int(r["max_repeats"] or 0)), max(1, -(-have.get(r["source"], (0, 0))[1] // shard_tokens))) for r in rows]
    size = spark.createDataFrame(size, "source string, max_repeats long, shards long")
    sharded = sized.join(F.broadcast(size), "source")
    sharded = sharded.withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.col("shards"))).withColumn("grp", F.floor(F.col("shard") / FAN))
    cap = F.ceil(F.col("tokens") / block) * F.col("max_repeats")
    shards = cut_lineage(sharded.groupBy("source", "max_repeats", "grp", "shard").agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", cap))
    caps = {r["source"]: r["cap"] for r in shards.groupBy("source").agg(F.sum("cap").alias("cap")).collect()}
    quotas = sainte_lague([max(0.0, r["target_share"] or 0.0) for r in rows], [caps.get(r["source"], 0) for r in rows], round(total / block))
    plan = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), *have.get(r["source"], (0, 0)), q) for r, q in zip(rows, quotas)]
    plan = spark.createDataFrame(plan, "source string, target_share double, max_repeats long, n_documents long, available_tokens long, source_quota long")

    groups = shards.groupBy("source", F.col("grp").alias("part")).agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).join(F.broadcast(plan.select("source", "source_quota")), "source")
    groups = _apportion(groups.select("source", "source_quota", "part", "tokens", "cap"), ["source"], "source_quota", "source string, part long, tokens long, cap long, quota long")
    shards = shards.join(groups.select("source", F.col("part").alias("grp"), F.col("quota").alias("group_quota")), ["source", "grp"])
    shards = _apportion(shards.select("source", "grp", "group_quota", F.col("shard").alias("part"), "tokens", "cap"), ["source", "grp"], "group_quota", "source string, grp long, part long, tokens long, cap long, quota long")

    placed = sharded.select("source", "shard", "doc_id", "n_tokens", F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("place")).join(shards.where("quota > 0").select("source", F.col("part").alias("shard"), "quota"), ["source", "shard"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    drawn = placed.groupBy("source", "shard").applyInPandas(_picker(seed, block), f"doc_id {kind}, source string, shard long, block long, start_token long, n_tokens long, times long")

    used = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"))
    report = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    report = report.withColumn("all_used", F.sum("used_tokens").over(Window.partitionBy()))
    reached = F.coalesce(F.col("used_tokens") / F.nullif(F.col("all_used"), F.lit(0)), F.lit(0.0))
    return drawn, report.select("source", "target_share", "max_repeats", "n_documents", "available_tokens", (F.col("source_quota") * block).alias("quota_tokens"), "used_tokens", (F.col("used_tokens") - F.col("source_quota") * block).alias("over_tokens"), reached.alias("reached_share"), (F.col("target_share") - reached).alias("missed_share"))


def seats(targets: DataFrame, records: DataFrame, total: int | None = None) -> DataFrame:
    """(source, seats): the same apportionment of whole records: `total` uses, by default the number of records of listed sources, go to the
    listed sources by the highest quotients, to each at most its records times max_repeats. records: (source)."""
    spark, rows = targets.sparkSession, listed_sources(targets)
    wanted = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    have = {r["source"]: r["n"] for r in records.select(source_key("source").alias("source")).join(F.broadcast(wanted), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    caps = [have.get(r["source"], 0) * max(0, r["max_repeats"] or 0) for r in rows]
    got = sainte_lague([max(0.0, r["target_share"] or 0.0) for r in rows], caps, sum(have.values()) if total is None else total)
    return spark.createDataFrame([(r["source"], g) for r, g in zip(rows, got)], "source string, seats long")
