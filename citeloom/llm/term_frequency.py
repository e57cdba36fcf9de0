"""Frequency of every distinct term, by burst-trie counting.

Each task feeds its terms to one burst trie per field: characters lead down access nodes to containers of
suffixes with two counters (uses, records), and a container that outgrows BURST suffixes bursts into an access
node with one container per next character. So prefixes are long where terms are dense and short elsewhere. The
containers leave the task as compact sorted blocks keyed by the prefix at which they hang.

Tries of different tasks burst at different depths. A routing table makes them meet: the prefixes under which
more than ROUTE_SUFFIXES shipped suffixes lie, or 1/ROUTES of all if that is less. So no route holds more than ROUTE_SUFFIXES,
however many there are in all, and the table has at most one entry per length and ROUTE_SUFFIXES suffixes; lengths end at
ROUTE_DEPTH, below which a hash of the suffix splits what is still too much for one route. Every block is cut at the
routing prefixes and equal routes are merged, in order, one route at a time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import term
from citeloom.session import cut_lineage, shuffle_width

BURST = 256
#: Suffixes that a task's tries hold before they are shipped and begun anew; bounds a task's memory.
TRIE_ENTRIES = 300_000
ROUTES = 256
ROUTE_SUFFIXES = 500_000
ROUTE_DEPTH = 24
#: Parts into which a prefix that is heavy at ROUTE_DEPTH is split at least; more where there are more routes.
DEEP_SPLIT = 64
BLOCK = "field_name string, prefix string, n long, block binary"


class BurstTrie:
    """Strings with (uses, records) counters. An access node is a dict of next characters with "" for the string that ends
    there; a container is a Container. Both are kept compact: a chain of single characters is not expanded before a burst."""

    class Container(dict):
        """suffix -> [uses, records]"""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.entries = burst, BurstTrie.Container(), 0

    def add(self, text: str, uses: int, records: int) -> None:
        node, parent, edge, at = self.root, None, "", 0
        while type(node) is dict:
            parent, edge = node, text[at : at + 1]
            at += len(edge)
            node = node.get(edge)
            if node is None:
                node = parent[edge] = BurstTrie.Container()
        suffix = text[at:]
        have = node.get(suffix)
        if have is None:
            node[suffix] = [uses, records]
            self.entries += 1
            if len(node) > self.burst:
                burst = self._burst(node)
                if parent is None:
                    self.root = burst
                else:
                    parent[edge] = burst
        else:
            have[0] += uses
            have[1] += records

    @staticmethod
    def _burst(container: Container) -> dict:
        node: dict = {}
        for suffix, counts in container.items():
            below = node.get(suffix[:1])
            if below is None:
                below = node[suffix[:1]] = BurstTrie.Container()
            below[suffix[1:]] = counts
        return node

    def containers(self) -> Iterator[tuple[str, dict]]:
        """Every container with its prefix, in the prefixes' order."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                stack += [(prefix + edge, node[edge]) for edge in sorted(node, reverse=True)]
            elif node:
                yield prefix, node


def encode_block(container: dict) -> bytes:
    """Sorted suffixes and counters, compressed."""
    return zlib.compress(json.dumps([[s, *container[s]] for s in sorted(container)], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def decode_block(block: bytes) -> list:
    return json.loads(zlib.decompress(block).decode("utf-8", "surrogatepass"))


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tries: dict[str, BurstTrie] = {}

    def ship() -> pd.DataFrame:
        rows = [(field, prefix, len(c), encode_block(c)) for field, trie in tries.items() for prefix, c in trie.containers()]
        return pd.DataFrame(rows, columns=["field_name", "prefix", "n", "block"])

    for batch in batches:
        # equal terms of a batch go down the trie once
        sums = batch.groupby(["field_name", "term"], sort=False)[["uses", "records"]].sum()
        for (field, text), uses, records in zip(sums.index, sums["uses"].tolist(), sums["records"].tolist()):
            trie = tries.get(field)
            if trie is None:
                trie = tries[field] = BurstTrie()
            trie.add(text, uses, records)
        if sum(t.entries for t in tries.values()) > TRIE_ENTRIES:
            yield ship()
            tries = {}
    yield ship()


def heavy_prefixes(blocks: DataFrame, routes: int = ROUTES, depth: int = ROUTE_DEPTH) -> dict[str, set[str]]:
    """Per field the prefixes of up to depth characters under which more than 1/routes of its suffixes lie."""
    lengths = F.explode(F.sequence(F.lit(0), F.least(F.length("prefix"), F.lit(depth)))).alias("k")
    under = blocks.select("field_name", "prefix", "n", lengths).groupBy("field_name", F.expr("substring(prefix, 1, k)").alias("p")).agg(F.sum("n").alias("n"))
    total = under.where("p = ''").select("field_name", F.col("n").alias("total"))
    heavy: dict[str, set[str]] = {}
    for row in under.join(F.broadcast(total), "field_name").where(F.col("n") * routes > F.col("total")).select("field_name", "p").toLocalIterator():
        heavy.setdefault(row["field_name"], set()).add(row["p"])
    return heavy


def route(text: str, heavy: set[str], depth: int = ROUTE_DEPTH, split: int = DEEP_SPLIT) -> str:
    """The shortest prefix of text that is not heavy, or text itself; below depth a split by hash is appended."""
    k = 0
    while k < len(text) and text[:k] in heavy:
        if k == depth:
            return f"{text[:k]}\0{zlib.crc32(text.encode('utf-8', 'surrogatepass')) % split}"
        k += 1
    return text[:k]


def term_counts(terms: DataFrame) -> DataFrame:
    """uses and records of every term: (field_name, term, uses, records).

    terms: (field_name STRING, term STRING, uses LONG, records LONG), any number of rows per term, whose counters
    are added up. Null terms must have been left out; a null field is no field. An empty table gives an empty one. Ties do
    not arise; repeated rows add up.
    """
    spark = terms.sparkSession
    blocks = cut_lineage(terms.select("field_name", "term", "uses", "records").mapInPandas(_build, BLOCK))
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    routes = max(ROUTES, -(-total // ROUTE_SUFFIXES))
    heavy, split = heavy_prefixes(blocks, routes), max(DEEP_SPLIT, routes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, prefix, block in zip(batch["field_name"], batch["prefix"], batch["block"]):
                parts: dict[str, dict] = {}
                mine = heavy.get(field, set())
                for suffix, uses, records in decode_block(block):
                    text = prefix + suffix
                    parts.setdefault(route(text, mine, split=split), {})[text] = (uses, records)
                rows += [(field, r, len(p), encode_block(p)) for r, p in parts.items()]
            yield pd.DataFrame(rows, columns=["field_name", "prefix", "n", "block"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, trie = None, BurstTrie()

        def done() -> Iterator[pd.DataFrame]:
            for prefix, c in trie.containers():
                yield pd.DataFrame([(at[0], prefix + s, *counts) for s, counts in c.items()], columns=["field_name", "term", "uses", "records"])

        for batch in batches:
            for field, r, block in zip(batch["field_name"], batch["prefix"], batch["block"]):
                if at != (field, r):
                    if at is not None:
                        yield from done()
                    at, trie = (field, r), BurstTrie()
                for text, uses, records in decode_block(block):
                    trie.add(text, uses, records)
        if at is not None:
            yield from done()

    routed = blocks.mapInPandas(cut, BLOCK).repartition(shuffle_width(spark), "field_name", "prefix").sortWithinPartitions("field_name", "prefix")
    return routed.mapInPandas(merge, "field_name string, term string, uses long, records long")


def term_frequencies(df: DataFrame, record: str, fields: list[str], rare_below: int = 3, common_one_in: int = 10) -> DataFrame:
    """(field_name, term, uses, records, mark) for every term of the array columns `fields`.

    A record is a distinct non-null value of `record`, all its rows together; n is their number over all rows. uses counts
    every occurrence in every row with a record, repeated rows included; records counts records. mark is `rare` for fewer than rare_below
    records, else `common` for more than one in common_one_in of the n records, else null. Null arrays, null and blank terms count as
    nothing; rows with a null record are left out. An empty table gives no rows.

    Rows are grouped by (field, record, term) first, which combines on the map side, so a record or a term that
    holds a third of all rows makes no task larger.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("array<string>").alias("terms")) for f in fields])).alias("s")
    long = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), each).select("record", "s.field_name", F.explode("s.terms").alias("t"))
    long = long.select("record", "field_name", term(F.col("t")).alias("term")).where(F.col("term").isNotNull())
    once = long.groupBy("field_name", "record", "term").agg(F.count(F.lit(1)).alias("uses"))
    counts = term_counts(once.select("field_name", "term", "uses", F.lit(1).cast("long").alias("records")))
    n = df.select(F.col(record).alias("record")).where(F.col("record").isNotNull()).distinct().count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_one_in > n, "common")
    return counts.withColumn("mark", mark)
