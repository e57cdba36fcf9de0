"""Evaluation texts that stand in corpus documents: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as streams of letters and digits. Every n-gram of an item's stream is a seed, with its place. How many
seeds a case must share follows from how dense its breaks (jumps, insertions, changed words) may be: a case has more than BREAK
repeated letters to a break. BREAK is a parameter; 10 is what the alignment takes off for a changed word of five letters. Of M
repeated letters in runs between fewer than M / BREAK breaks, each run of r letters holds r - n + 1 seeds in order, so that they show

    M - (M / BREAK + 1) (n - 1) = M (1 - (n - 1) / BREAK) - (n - 1)

seeds or more, in the item's order. With M half of the item this is `seeds_needed`. If an item needs T of S seeds, its T - 1
commonest ones can't make a case alone: a document is joined to an item through one of the other, rare seeds, whatever it
shares besides, and kept if the longest chain of shared seeds in order reaches T. No seed and no document is dropped for being
frequent. The document is then aligned from its first shared seed to its last, and beyond on both sides as far as the item's
own letters go, locally, with affine gaps that cost to open and nothing to extend, so that copies in a few pieces, with
insertions and changed words, are one alignment. Finding and aligning are one pass over the documents, without a shuffle; many
pairs are aligned at once, and equal ones once in a task.

Items are held in memory block by block (BLOCK_ITEMS, BLOCK_LETTERS).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import plain
from citeloom.session import spread

MATCH, MISMATCH, OPEN = 1, -2, -8
#: Letters of a seed in scripts of letters, and in those of syllables and ideographs.
LONG, SHORT = 7, 4
#: Repeated letters to a break at least, by seed length: MISMATCH for each of a word's five letters, or two to three syllables. A gap costs
#: only OPEN, so a copy whose insertions stand 8 to 10 letters apart could still align with profit and isn't looked at; with 8 and 4
#: it would be, at four times the candidates.
BREAK = {LONG: 10, SHORT: 5}
#: Items of a block, and letters of their texts on average: 16 bytes of seeds a letter are broadcast.
BLOCK_ITEMS, BLOCK_LETTERS = 2_000, 4_000_000
#: Letters of documents that are hashed at once.
WINDOW = 1_000_000
#: Cells of the alignment that are worked on at once.
CELLS = 12_000
#: Alignments that a task remembers.
REMEMBERED = 100_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: High bits of a hash by which a table tells quickly that it is no seed.
_BITS = 20


def _points(stream: str) -> np.ndarray:
    return np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n-gram."""
    if len(points) < n:
        return np.array([], dtype=np.uint64)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * _PRIME
    mixed ^= mixed >> np.uint64(29)
    count = len(points) - n + 1
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(6364136223846793005)
        out += mixed[k : k + count]
    return out ^ (out >> np.uint64(31))


def seed_length(stream: str) -> int:
    points = _points(stream)
    return LONG if len(points) == 0 or (points < 0x2E80).mean() > 0.6 else SHORT


def seeds_needed(letters: int, n: int, least: float) -> int:
    """Seeds in order that a copy of `least` of an item's letters shows at least; see the module's text."""
    return max(1, int(np.ceil(least * letters * (1 - (n - 1) / BREAK[n]) - (n - 1) - 1e-9)))


class _Seeds:
    """The seeds of a block of items in order of their hashes, with the item and the place each has."""

    def __init__(self, items: list[tuple[int, str]], least: float):
        self.ids = [i for i, _ in items]
        self.streams = [_points(s).astype(np.int64) for _, s in items]
        lengths = [seed_length(s) for _, s in items]
        self.lengths = sorted(set(lengths))
        self.needed = np.array([seeds_needed(len(s), n, least) for s, n in zip(self.streams, lengths)], dtype=np.int64)
        each = [_hashes(_points(s), n) for (_, s), n in zip(items, lengths)]
        empty = [np.array([], dtype=np.uint64)]
        hashes = np.concatenate(empty + each)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), [len(h) for h in each])
        place = np.concatenate([np.array([], dtype=np.int32)] + [np.arange(len(h), dtype=np.int32) for h in each])
        # how many items hold a seed; the needed - 1 commonest seeds of an item are not rare
        held = np.unique(np.concatenate(empty + [np.unique(h) for h in each]), return_counts=True)
        common = held[1][np.searchsorted(held[0], hashes)] if len(hashes) else np.array([], dtype=np.int64)
        order = np.lexsort((hashes, common, owner))
        start = np.r_[0, np.cumsum([len(h) for h in each])]
        rare = np.zeros(len(hashes), dtype=bool)
        for k, h in enumerate(each):
            rare[order[start[k] : start[k] + max(0, len(h) - self.needed[k] + 1)]] = True
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place, self.rare, hashes = owner[order], place[order], rare[order], hashes[order]
        self.distinct, self.first, self.count = np.unique(hashes, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(self.distinct >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in points, entries of this table) of all shared n-grams."""
        places, entries = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
        for n in self.lengths:
            for begin in range(0, len(points) - n + 1, WINDOW):
                h = _hashes(points[begin : begin + WINDOW + n - 1], n)
                ok = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.distinct, h[ok]), len(self.distinct) - 1)
                same = self.distinct[at] == h[ok]
                ok, at = ok[same], at[same]
                n_each = self.count[at]
                places.append(np.repeat(ok + begin, n_each))
                entries.append(np.repeat(self.first[at] - np.r_[0, np.cumsum(n_each)[:-1]], n_each) + np.arange(n_each.sum()) if len(at) else np.array([], dtype=np.int64))
        return np.concatenate(places), np.concatenate(entries)


def longest_chain(xs: np.ndarray, ys: np.ndarray) -> int:
    """The most of the points (x, y) that go up in both."""
    tails: list[int] = []
    for y in ys[np.lexsort((-ys, xs))].tolist():
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
        else:
            tails[k] = y
    return len(tails)


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(score, matched) of the best local alignment of each pair (item, document) of code points.

    matched is the number of equal letters on the alignment that gives the score; of equal scores the one with more counts.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted((k for k in range(len(pairs)) if len(pairs[k][0]) and len(pairs[k][1])), key=lambda k: (len(pairs[k][0]) // 64, len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        take, wide = [], 0
        while at < len(order):
            longest = max(wide, len(pairs[order[at]][0]))
            if take and (len(take) + 1) * longest > CELLS:
                break
            wide = longest
            take.append(order[at])
            at += 1
        for k, value in zip(take, _align_block([pairs[k] for k in take], wide)):
            out[k] = value
    return out


def _align_block(pairs: list[tuple[np.ndarray, np.ndarray]], m: int) -> list[tuple[int, int]]:
    """Gotoh's recurrences, a letter of every document at a time, over all of its item's letters.

    A cell holds score * 2^bits + matched. As gaps cost nothing to extend, the best gap that ends at a cell is OPEN less
    than the largest cell before it: a running maximum along the item, and one along the document.
    """
    count, n = len(pairs), max(len(b) for _, b in pairs)
    kind, bits = (np.int32, 16) if m < 16_000 else (np.int64, 32)
    hit, miss, gap = kind((MATCH << bits) + 1), kind(MISMATCH << bits), kind(OPEN << bits)
    # of every item and letter, what the letter scores at each of the item's places; row 0 is a letter that equals none
    rows, at = [np.full((1, m), miss, dtype=kind)], 1
    known: dict[int, tuple[np.ndarray, int]] = {}
    turns = np.zeros((n, count), dtype=np.int64)
    for r, (x, y) in enumerate(pairs):
        if id(x) not in known:
            letters = np.unique(x)
            profile = np.full((len(letters), m), miss, dtype=kind)
            profile[:, : len(x)][letters[:, None] == x[None, :]] = hit
            rows.append(profile)
            known[id(x)] = letters, at
            at += len(letters)
        letters, base = known[id(x)]
        k = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
        turns[: len(y), r] = np.where(letters[k] == y, base + k, 0)
    profiles = np.concatenate(rows)
    h, high = np.zeros((count, m + 1), dtype=kind), np.zeros((count, m), dtype=kind)  # column 0 is the border
    cell, along = np.empty((count, m), dtype=kind), np.empty((count, m), dtype=kind)
    for turn in turns:
        np.take(profiles, turn, axis=0, out=cell, mode="clip")
        cell += h[:, :-1]
        np.add(high, gap, out=along)  # from cells of earlier letters of the document
        np.maximum(cell, along, out=cell)
        np.maximum(cell, 0, out=cell)
        np.maximum.accumulate(cell, axis=1, out=along)
        along += gap  # from earlier letters of the item; its own place, less a gap, changes nothing
        np.maximum(cell, along, out=h[:, 1:])
        np.maximum(high, h[:, 1:], out=high)
    best = high.max(axis=1).tolist()
    return [(v >> bits, v & ((1 << bits) - 1)) for v in best]


def _chunks(streams: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of streams of WINDOW letters together, or of one longer stream."""
    begin, size = 0, 0
    for k, s in enumerate(streams):
        if k > begin and size + len(s) > WINDOW:
            yield begin, k
            begin, size = k, 0
        size += len(s) + 1
    if begin < len(streams):
        yield begin, len(streams)


def _candidates(seeds: _Seeds, streams: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number of the stream, number of the item, the part of the stream to align) of all pairs that share enough seeds."""
    for begin, end in _chunks(streams):
        points = _points("\n".join(streams[begin:end]))  # no stream has a line break
        starts = np.cumsum([0, *(len(s) + 1 for s in streams[begin : end - 1])])
        places, entries = seeds.hits(points)
        doc, item = np.searchsorted(starts, places, "right") - 1, seeds.owner[entries]
        key = doc * len(seeds.ids) + item
        pairs, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        joined = np.bincount(which, weights=seeds.rare[entries], minlength=len(pairs)) > 0
        good = joined & (counts >= seeds.needed[pairs % len(seeds.ids)])
        chosen = np.flatnonzero(good[which])
        chosen = chosen[np.argsort(which[chosen], kind="stable")]
        for at in np.split(chosen, np.flatnonzero(np.diff(which[chosen])) + 1) if len(chosen) else []:
            d, i = divmod(int(key[at[0]]), len(seeds.ids))
            x, y = places[at] - starts[d], seeds.place[entries[at]].astype(np.int64)
            if longest_chain(x, y) >= seeds.needed[i]:
                low, high = max(0, int((x - y).min())), min(len(streams[begin + d]), int((x - y).max()) + len(seeds.streams[i]))
                yield begin + d, i, points[starts[d] + low : starts[d] + high].astype(np.int64)


def _leaks_of_block(documents: DataFrame, items: list[tuple[int, str]], least: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(_Seeds(items, least))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, known = shared.value, {}
        for batch in batches:
            batch = batch[batch["text"].notna()]
            keys, pairs = [], {}
            if len(known) > REMEMBERED:
                known = {}
            docs = batch["doc_id"].tolist()
            for d, i, part in _candidates(seeds, [plain(t) for t in batch["text"]]) if len(seeds.distinct) else ():
                key = i, hashlib.blake2b(part.tobytes(), digest_size=16).digest()
                keys.append((docs[d], i, key))
                if key not in known:
                    pairs[key] = seeds.streams[i], part
            known |= zip(pairs, align([*pairs.values()]))
            rows = [(doc, seeds.ids[i], *known[key], known[key][1] / len(seeds.streams[i])) for doc, i, key in keys if known[key][1] >= least * len(seeds.streams[i])]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "matched", "share"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return spread(documents.select("doc_id", "text")).mapInPandas(work, f"doc_id {kind}, item_id long, score long, matched long, share double")


def leaks(documents: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, matched, share) of documents that repeat at least `least` of an item's letters and digits, in order.

    documents: (doc_id, text); items: (item_id LONG, text). Every row of documents counts, copies too; null and empty
    texts are in no case, nor are items of fewer letters than a seed. Of rows that repeat an item_id the longest text counts.
    Texts are read whole, however long. Empty tables give no cases. Columns besides those named are dropped.
    """
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("text"))
    n, letters = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-letters // BLOCK_LETTERS))
    out = None
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else known
        found = _leaks_of_block(documents, sorted((r["item_id"], plain(r["text"])) for r in part.collect()), least)
        out = found if out is None else out.unionAll(found)
    return out
