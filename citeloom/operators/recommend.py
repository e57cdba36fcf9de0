"""Recommendations: similarity of stated queries to all items, top-k and bottom-k, negatives.

Queries are a stated set, taken in blocks as large as a broadcast may be; a block is scored against the items' partitions
where they lie, some queries and items at a time, and a partition sends only its k best rows per query. No pair is made that
isn't scored and no list of pairs is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions.vectors import sigmoid
from citeloom.operators.numbering import dense_ids
from citeloom.session import cut_lineage, shuffle_width

#: Numbers that a block of queries may hold and that are broadcast with it; 64 MB.
BLOCK_VALUES = 8_000_000
#: Scores that are worked on at once.
CELLS = 2_000_000
#: Positives whose negatives are drawn at once.
DRAWN = 100_000


def _blocks(queries: DataFrame, key: str, width: int, size: int | None) -> list[DataFrame]:
    """Parts of the queries, of `size` rows, or as many as have BLOCK_VALUES numbers of which each row has `width`."""
    n, size = queries.count(), size or max(1, BLOCK_VALUES // max(width, 1))
    blocks = max(1, -(-n // size))
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _ranked(df: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """(query_id, rk, item_id, score) by the score to 9 places, then item_id."""
    by = F.round("score", 9)
    order = Window.partitionBy("query_id").orderBy(by.asc() if ascending else by.desc(), "item_id")
    return df.withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= k).select("query_id", "rk", "item_id", F.round("score", 6).alias("score"))


class _Best:
    """The k best items of each of n queries so far: by the score to 9 places, then by id. NaN scores are out."""

    def __init__(self, n: int, k: int, ascending: bool = False):
        self.k, self.sign = k, 1.0 if ascending else -1.0
        self.ids, self.scores = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.nan)

    def _pick(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best columns of each row, of columns in order of ids."""
        if scores.shape[1] <= self.k:
            return scores, ids
        key = np.round(scores, 9) * self.sign
        key[np.isnan(key)] = np.inf
        last = np.partition(key, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        below, equal = key < last, key == last
        below |= equal & (np.cumsum(equal, axis=1) <= self.k - below.sum(axis=1, keepdims=True))
        return scores[below].reshape(-1, self.k), ids[below].reshape(-1, self.k)

    def add(self, begin: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows of the queries from `begin` on, columns of the items `ids`, which go up."""
        end = begin + len(scores)
        new, new_ids = self._pick(scores, np.broadcast_to(ids, scores.shape))
        both, both_ids = np.hstack([self.scores[begin:end], new]), np.hstack([self.ids[begin:end], new_ids])
        order = np.argsort(both_ids, axis=1, kind="stable")
        self.scores[begin:end], self.ids[begin:end] = self._pick(np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1))

    def rows(self, queries: np.ndarray) -> pd.DataFrame:
        known = ~np.isnan(self.scores)
        return pd.DataFrame({"query_id": np.repeat(queries, known.sum(axis=1)), "item_id": self.ids[known], "score": self.scores[known]})


def _hide(scores: np.ndarray, queries: np.ndarray, seen_by: pd.Series) -> None:
    for c, by in enumerate(seen_by):
        if by is not None and len(by):
            at = np.searchsorted(queries, np.asarray(by, dtype=np.int64))
            ok = at < len(queries)
            ok[ok] = queries[at[ok]] == np.asarray(by, dtype=np.int64)[ok]
            scores[at[ok], c] = np.nan


def _seen_by(items: DataFrame, seen: DataFrame | None, part: DataFrame) -> DataFrame:
    """items with seen_by, the queries of one block that have seen the item."""
    if seen is None:
        return items.withColumn("seen_by", F.lit(None).cast("array<bigint>"))
    by = seen.join(part, "query_id", "left_semi").groupBy("item_id").agg(F.collect_set(F.col("query_id").cast("long")).alias("seen_by"))
    return items.join(by, "item_id", "left")


def vector_topk(items: DataFrame, queries: DataFrame, k: int = 5, cosine: bool = True, seen: DataFrame | None = None, own: bool = False, block: int | None = None) -> DataFrame:
    """(query_id, rk, item_id, score): the k items of highest score to each query.

    items and queries: (id LONG, vector ARRAY of one length). score is (cosine + 1) / 2, or the sigmoid of the dot product. With own,
    an item may be its query; without, it is left out, and so are the items of seen (query_id, item_id). Null and empty vectors
    are in no result; a zero vector's cosine is 0. Ties, to 9 places, go to the smaller id. block: queries of a block.
    """
    spark = items.sparkSession
    items = items.select(F.col("id").cast("long").alias("item_id"), "vector").where("item_id is not null and size(vector) > 0")
    queries = cut_lineage(queries.select(F.col("id").cast("long").alias("query_id"), "vector").where("query_id is not null and size(vector) > 0"))

    def score_block(part: DataFrame) -> DataFrame:
        rows = part.collect()  # one block
        ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        order = np.argsort(ids)
        ids, matrix = ids[order], np.array([r["vector"] for r in rows], dtype=float)[order] if len(rows) else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast((ids, _unit(matrix) if cosine and len(rows) else matrix))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            best = _Best(len(qids), k)
            for batch in batches:
                if not len(batch) or not len(qids):
                    continue
                batch = batch.sort_values("item_id")
                iids, vectors = batch["item_id"].to_numpy(dtype=np.int64), np.stack(batch["vector"].to_numpy()).astype(float)
                vectors = _unit(vectors) if cosine else vectors
                step = max(1, CELLS // len(iids))
                for begin in range(0, len(qids), step):
                    scores = q[begin : begin + step] @ vectors.T
                    scores = (scores + 1) / 2 if cosine else 1 / (1 + np.exp(-scores))
                    mine = qids[begin : begin + step]
                    if not own:
                        scores[mine[:, None] == iids[None, :]] = np.nan
                    _hide(scores, mine, batch["seen_by"])
                    best.add(begin, scores, iids)
            yield best.rows(qids)

        return _seen_by(items, seen, part.select("query_id")).mapInPandas(score, "query_id long, item_id long, score double")

    width = queries.agg(F.max(F.size("vector"))).first()[0] or 1
    return _ranked(_union([score_block(b) for b in _blocks(queries, "query_id", width, block)]), k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dot_scores(left: DataFrame, right: DataFrame, block: int | None = None) -> DataFrame:
    """(a_id, b_id, score): sigmoid of the dot product of every query (left) with every other row of right; left is taken in blocks."""

    def score_block(part: DataFrame) -> DataFrame:
        rows = [r for r in part.collect() if r["id"] is not None and r["vector"]]
        ids, q = np.array([r["id"] for r in rows], dtype=np.int64), np.array([r["vector"] for r in rows], dtype=float)
        shared = right.sparkSession.sparkContext.broadcast((ids, q))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            for batch in batches:
                batch = batch[batch["vector"].map(lambda v: v is not None and len(v) > 0)]
                if not len(batch) or not len(qids):
                    continue
                own, vectors = batch["id"].to_numpy(dtype=np.int64), np.stack(batch["vector"].to_numpy()).astype(float)
                step = max(1, CELLS // len(own))
                for begin in range(0, len(qids), step):
                    mine = qids[begin : begin + step]
                    out = pd.DataFrame({"a_id": np.repeat(mine, len(own)), "b_id": np.tile(own, len(mine)), "x": (q[begin : begin + step] @ vectors.T).ravel()})
                    yield out[out["a_id"] != out["b_id"]]

        return right.select(F.col("id").cast("long").alias("id"), "vector").where("id is not null").mapInPandas(score, "a_id long, b_id long, x double")

    width = left.agg(F.max(F.size("vector"))).first()[0] or 1
    out = _union([score_block(b) for b in _blocks(left, "id", width, block)])
    return out.select("a_id", "b_id", F.round(sigmoid(F.col("x")), 6).alias("score"))


def bag_ranking(profiles: DataFrame, bags: DataFrame, seen: DataFrame | None, k: int = 5, ascending: bool = False, block: int | None = None) -> DataFrame:
    """(query_id, rk, item_id, score): for each profile the k items of highest (or lowest) (cosine + 1) / 2 of weighted keyword bags.

    profiles: (query_id LONG, keyword, weight); bags: (item_id LONG, keyword, weight). Items in seen (query_id, item_id) are left
    out. Items without a shared keyword score 0.5, as for a profile of unknown keywords or of no weight; ties go to the smaller item_id.
    An item's seen-by list holds queries of one block only, so its length is bounded by the block.
    """
    spark = bags.sparkSession
    item_lists = cut_lineage(bags.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.collect_list(F.struct("keyword", F.col("weight").cast("double").alias("weight"))).alias("bag")))
    parts = []
    widest = profiles.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    # a keyword of a profile counts as eighty numbers: it takes more room, and some hundred items should fit beside the queries
    for part in _blocks(profiles.select("query_id").distinct(), "query_id", 80 * widest, block):
        mine = profiles.join(part, "query_id", "left_semi").select(F.col("query_id").cast("long").alias("query_id"), "keyword", F.col("weight").cast("double").alias("weight"))
        words: dict[str, dict[int, float]] = {}
        squares: dict[int, float] = {}
        for r in mine.toLocalIterator():  # the profiles of one block
            words.setdefault(r["keyword"], {})[r["query_id"]] = r["weight"]
            squares[r["query_id"]] = squares.get(r["query_id"], 0.0) + r["weight"] ** 2
        ids = np.array(sorted(squares), dtype=np.int64)
        if not len(ids):
            continue
        at = {q: i for i, q in enumerate(ids.tolist())}
        norms = np.sqrt([squares[q] for q in ids.tolist()])
        postings = {w: (np.array([at[q] for q in qs], dtype=np.int64), np.array(list(qs.values()))) for w, qs in words.items()}
        shared = spark.sparkContext.broadcast((ids, norms, postings))
        rows = _seen_by(item_lists, seen, part)

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, norms, postings = shared.value
            best = _Best(len(ids), k, ascending)
            for whole in batches:
                whole = whole.sort_values("item_id")
                step = max(1, CELLS // len(ids))
                for begin in range(0, len(whole), step):
                    batch = whole.iloc[begin : begin + step]
                    own = batch["item_id"].to_numpy(dtype=np.int64)
                    scores = np.zeros((len(ids), len(own)))
                    for c, bag in enumerate(batch["bag"]):
                        square = 0.0
                        for x in bag:
                            square += x["weight"] ** 2
                            if x["keyword"] in postings:
                                rows_, weights = postings[x["keyword"]]
                                scores[rows_, c] += weights * x["weight"]
                        if square > 0:
                            scores[:, c] /= np.where(norms > 0, norms, 1.0) * np.sqrt(square)
                    scores = (scores + 1) / 2
                    _hide(scores, ids, batch["seen_by"])
                    best.add(0, scores, own)
            yield best.rows(ids)

        parts.append(rows.mapInPandas(score, "query_id long, item_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rk long, item_id long, score double")
    return _ranked(_union(parts), k, ascending)


def _draws(positives: DataFrame, per_positive: int, tries: int, seed: int) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(distinct positives, numbered items, their count, accepted draws (user_id, of, item_id, j, i)).

    per_positive draws are made for every positive, the other ones only where some of those were rejected.
    """
    pairs = cut_lineage(positives.where("user_id is not null and item_id is not null").select("user_id", "item_id").distinct())
    items = cut_lineage(dense_ids(pairs.select("item_id").distinct(), ["item_id"], "number"))
    n = items.count()

    def accepted(rows: DataFrame, first: int, last: int) -> DataFrame:
        drawn = rows.withColumn("j", F.explode(F.sequence(F.lit(first), F.lit(last))))
        number = F.pmod(F.col("user_id") * 7919 + F.col("of") * 104729 + F.col("j") * 1299709 + seed, F.lit(max(n, 1)))
        return drawn.withColumn("number", number).join(items, "number").join(pairs, ["user_id", "item_id"], "left_anti")

    every = pairs.select("user_id", F.col("item_id").alias("of"))
    order = Window.partitionBy("user_id", "of").orderBy("j")
    soon = cut_lineage(accepted(every, 0, per_positive - 1).select("user_id", "of", "item_id", "j").withColumn("i", F.row_number().over(order)))
    if tries <= per_positive:
        return pairs, items, n, soon
    full = soon.where(F.col("i") == per_positive).select("user_id", "of")
    short = every.join(full, ["user_id", "of"], "left_anti").join(soon.groupBy("user_id", "of").agg(F.max("i").alias("got")), ["user_id", "of"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = accepted(short, per_positive, tries - 1).withColumn("i", F.row_number().over(order) + F.col("got")).where(F.col("i") <= per_positive)
    return pairs, items, n, soon.unionByName(late.select("user_id", "of", "item_id", "j", "i"))


def negative_samples(positives: DataFrame, per_positive: int = 4, tries: int = 8, seed: int = 17) -> DataFrame:
    """(user_id, item_id, draw): up to per_positive items for each distinct positive (user_id, item_id) that the user has no positive with.

    Draw j of a positive is item number (user * 7919 + item * 104729 + j * 1299709 + seed) mod n of the distinct items in order; of
    `tries` draws the first that are no positives are kept, and an item drawn twice for one user counts once, at its first
    draw. So a user who has nearly every item gets fewer, and nothing loops. Null users and items are no positives.
    For training, where every positive needs all of its negatives, see training_negatives.
    """
    pairs, _, n, kept = _draws(positives, per_positive, tries, seed)
    if n == 0:
        return pairs.withColumn("draw", F.lit(0).cast("long"))
    return kept.groupBy("user_id", "item_id").agg(F.min("j").cast("long").alias("draw"))


def training_negatives(positives: DataFrame, per_positive: int = 4, tries: int = 8, seed: int = 17) -> DataFrame:
    """(user_id, of, item_id): exactly per_positive rows for each distinct positive (user_id, of), of items the user has no positive with.

    The draws are those of negative_samples, but nothing is merged. What `tries` draws leave open is taken from the user's
    unseen items: the first 60 bits of the MD5 of user:item:draw:seed, mod their count, are a place among them in order. So an item may be drawn
    again, as with redrawing. Only users who have every item get no rows.
    """
    pairs, items, n, kept = _draws(positives, per_positive, tries, seed)
    kept = cut_lineage(kept)
    got = kept.groupBy("user_id", "of").agg(F.count(F.lit(1)).cast("int").alias("n"))
    short = pairs.select("user_id", F.col("item_id").alias("of")).join(got, ["user_id", "of"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < per_positive)
    short = cut_lineage(short.select("user_id", "of", F.explode(F.sequence(F.col("n") + 1, F.lit(per_positive))).alias("i")))
    mine = pairs.join(short.select("user_id").distinct(), "user_id", "left_semi").join(items, "item_id").select("user_id", "number")
    unseen = mine.groupBy("user_id").agg((F.lit(n) - F.count(F.lit(1))).alias("unseen")).where("unseen > 0")
    mixed = F.substring(F.md5(F.concat_ws(":", "user_id", "of", "i", F.lit(seed))), 1, 15)
    place = F.conv(mixed, 16, 10).cast("long") % F.col("unseen")
    asked = short.join(unseen, "user_id").select("user_id", "of", place.alias("place"), F.lit(1).alias("ask"))
    # a positive's number less the positives before it is the count of unseen items before it
    before = mine.withColumn("place", F.col("number") - F.row_number().over(Window.partitionBy("user_id").orderBy("number")) + 1)
    both = before.select("user_id", F.lit(None).cast(pairs.schema["item_id"].dataType).alias("of"), "place", F.lit(0).alias("ask")).unionByName(asked)
    passed = F.count_if(F.col("ask") == 0).over(Window.partitionBy("user_id").orderBy("place", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = both.withColumn("number", F.col("place") + passed).where("ask = 1").join(items, "number").select("user_id", "of", "item_id")
    return kept.select("user_id", "of", "item_id").unionByName(filled)


def _unmet(user: np.ndarray, of: np.ndarray, number: np.ndarray, n: int, per_positive: int, tries: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the positive, number drawn) for whole users, whose positives are in order of user and number."""
    new = np.r_[True, user[1:] != user[:-1]]
    start, no = np.flatnonzero(new), np.cumsum(new) - 1
    end = np.r_[start[1:], len(user)]
    keys = no * n + number
    for begin in range(0, len(user), DRAWN):
        at = np.arange(begin, min(begin + DRAWN, len(user)))
        drawn = np.mod((user[at] * 7919 + of[at] * 104729 + seed)[:, None] + np.arange(tries) * 1299709, n)
        asked = (no[at] * n)[:, None] + drawn
        free = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] != asked
        rank = np.cumsum(free, axis=1)
        row, col = np.nonzero(free & (rank <= per_positive))
        yield at[row], drawn[row, col]
        got = np.minimum(rank[:, -1], per_positive)
        places, found = [], []
        before_of, before = -1, number[:0]
        for r in np.flatnonzero((got < per_positive) & (end[no[at]] - start[no[at]] < n)).tolist():
            a, b = start[no[at[r]]], end[no[at[r]]]
            if before_of != a:
                before_of, before = a, number[a:b] - np.arange(b - a)  # unseen items before each seen one
            for i in range(int(got[r]) + 1, per_positive + 1):
                place = int(hashlib.md5(f"{user[at[r]]}:{of[at[r]]}:{i}:{seed}".encode()).hexdigest()[:15], 16) % (n - int(b - a))
                places.append(at[r])
                found.append(place + int(np.searchsorted(before, place, side="right")))
        if places:
            yield np.array(places), np.array(found)


def training_numbers(positives: DataFrame, n: int, per_positive: int = 4, tries: int = 8, seed: int = 17) -> DataFrame:
    """(u, number, label): every distinct positive (user_id, item_id, u, number) as label 1, its negatives of training_negatives as label 0.

    number: the item's place among the n items in order. A user's positives lie together, so draws are checked against them in
    place: nothing is joined, and no draw is shuffled or written. The numbers of one user are held at once.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def drawn(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            user, of, u, number = (np.concatenate([f[c].to_numpy(dtype=np.int64) for f in frames]) for c in ("user_id", "item_id", "u", "number"))
            if not len(user):
                return
            for begin in range(0, len(user), DRAWN):
                yield pd.DataFrame({"u": u[begin : begin + DRAWN], "number": number[begin : begin + DRAWN], "label": 1})
            for at, found in _unmet(user, of, number, n, per_positive, tries, seed):
                yield pd.DataFrame({"u": u[at], "number": found, "label": 0})

        kept: list[pd.DataFrame] = []
        for frame in batches:
            if not len(frame):
                continue
            last = frame["user_id"].iloc[-1]
            if kept and kept[-1]["user_id"].iloc[-1] == last:  # the frame is all of the user that is kept
                kept.append(frame)
                continue
            cut = int(np.searchsorted(frame["user_id"].to_numpy(), last))
            yield from drawn([*kept, frame.iloc[:cut]])
            kept = [frame.iloc[cut:]]
        if kept:
            yield from drawn(kept)

    rows = positives.select(*[F.col(c).cast("long").alias(c) for c in ("user_id", "item_id", "u", "number")])
    return rows.repartition(shuffle_width(positives.sparkSession), "user_id").sortWithinPartitions("user_id", "number").mapInPandas(work, "u long, number long, label int")
