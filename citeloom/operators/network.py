"""A content-aware recommendation network, trained by partitions and averaged.

A user's vector and the mean of an item's keyword vectors, side by side, go through two layers to one number. The network is of
bounded size: users and keywords beyond a stated number share places by remainder. In every epoch each partition of the
examples goes through its own copy, mini-batch by mini-batch with Adam, and the copies are averaged by the rows they saw. Only
the network itself, whose size is the parameter's, goes to the driver and back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.recommend import CELLS, _Best, _blocks, _hide, _ranked, _seen_by, _union
from citeloom.session import cut_lineage, short_shuffles, shuffle_width

#: Places for users and for keywords at most.
PLACES = 65_536
#: Weights of a chunk that is averaged at once.
CHUNK = 65_536
#: Examples of an item that are written beside one copy of its lists.
TOGETHER = 1_024
#: Mini-batches whose indices and draws are made at once.
AHEAD = 128
#: A weight of a layer that is as good as 0.
NOTHING = 1e-20


@dataclass
class Network:
    """Weights by name; losses of the epochs it was trained for."""

    weights: dict[str, np.ndarray]
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def new(n_users: int, n_keywords: int, dim: int = 64, hidden: tuple[int, int] = (128, 64), places: int = PLACES, seed: int = 7) -> Network:
        """Xavier-initialised; place 0 of the keywords stands for none and stays zero."""
        rng = np.random.default_rng(seed)

        def xavier(a: int, b: int) -> np.ndarray:
            return rng.uniform(-1, 1, (a, b)).astype(np.float32) * np.float32(np.sqrt(6 / (a + b)))

        first, second = hidden
        zeros = lambda n: np.zeros((1, n), dtype=np.float32)
        net = Network({
            "users": xavier(max(1, min(n_users, places)), dim), "keywords": xavier(1 + min(n_keywords, places), dim),
            "w1": xavier(2 * dim, first), "b1": zeros(first), "w2": xavier(first, second), "b2": zeros(second), "w3": xavier(second, 1), "b3": zeros(1),
        })
        net.weights["keywords"][0] = 0
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def like(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for name, w in self.weights.items():
            out[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32, copy=False)
            at += w.size
        return Network(out, list(self.losses))

    def live(self) -> Network:
        """The network without units that get nothing or pass nothing on: it has the same scores."""
        w = self.weights
        one = ((w["w1"] != 0).any(0) | (w["b1"][0] != 0)) & (w["w2"] != 0).any(1)
        two = ((w["w2"] != 0).any(0) | (w["b2"][0] != 0)) & (w["w3"] != 0).any(1)
        return Network(w | {"w1": w["w1"][:, one], "b1": w["b1"][:, one], "w2": w["w2"][one][:, two], "b2": w["b2"][:, two], "w3": w["w3"][two]}, list(self.losses))

    def user_place(self, number: F.Column) -> F.Column:
        return F.pmod(number, F.lit(len(self.weights["users"]))).cast("int")

    def keyword_place(self, number: F.Column) -> F.Column:
        return (F.pmod(number - 1, F.lit(max(1, len(self.weights["keywords"]) - 1))) + 1).cast("int")


def bag_lists(bags: DataFrame, net: Network, weighted: bool = True) -> DataFrame:
    """(item_id, ids, shares): an item's keyword places and what each has of the bag, 1 in all; unweighted, each keyword counts once."""
    weight = F.col("weight").cast("float") if weighted else F.lit(1.0).cast("float")
    cells = bags.select("item_id", F.struct(net.keyword_place(F.col("keyword_id")).alias("k"), weight.alias("w")).alias("c"))
    lists = cells.groupBy("item_id").agg(F.array_sort(F.collect_list("c")).alias("cs"), F.sum("c.w").alias("total"))
    return lists.select("item_id", F.transform("cs", lambda c: c["k"]).alias("ids"), F.transform("cs", lambda c: (c["w"] / F.col("total")).cast("float")).alias("shares"))


def examples(pairs: DataFrame, users: DataFrame, lists: DataFrame, net: Network) -> DataFrame:
    """(u, ids, shares, label) of pairs (user_id, item_id, label); users: (user_id, u) numbered from 0. Items without a bag have empty lists."""
    none = F.array().cast("array<int>"), F.array().cast("array<float>")
    rows = pairs.join(users, "user_id").join(lists, "item_id", "left")
    return rows.select(net.user_place(F.col("u")).alias("u"), F.coalesce("ids", none[0]).alias("ids"), F.coalesce("shares", none[1]).alias("shares"), F.col("label").cast("float").alias("label"), "user_id", "item_id")


def packed(rows: DataFrame, lists: DataFrame, net: Network) -> DataFrame:
    """(number, ids, shares, codes) of examples (u, number, label): an item's lists stand once for up to TOGETHER of its examples.

    lists: (number, ids, shares). A code is twice the user's place, and 1 more for a positive.
    """
    code = (net.user_place(F.col("u")) * 2 + F.col("label")).cast("int").alias("code")
    codes = rows.select("number", code).repartition(shuffle_width(rows.sparkSession), "number").sortWithinPartitions("number", "code")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            number, code = frame["number"].to_numpy(), frame["code"].to_numpy()
            first = np.r_[True, number[1:] != number[:-1]][: len(number)]
            place = np.arange(len(number))
            begin = np.flatnonzero((place - np.maximum.accumulate(np.where(first, place, 0))) % TOGETHER == 0)
            yield pd.DataFrame({"number": number[begin], "codes": np.split(code, begin[1:]) if len(begin) else []})

    none = F.array().cast("array<int>"), F.array().cast("array<float>")
    each = codes.mapInPandas(runs, "number long, codes array<int>").join(lists, "number", "left")
    return each.select("number", F.coalesce("ids", none[0]).alias("ids"), F.coalesce("shares", none[1]).alias("shares"), "codes")


class _Bags:
    """The lists of a batch, one after another."""

    def __init__(self, ids: pd.Series, shares: pd.Series):
        self.size = np.array([len(x) for x in ids], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids] + [np.array([], dtype=np.int64)])
        self.shares = np.concatenate([np.asarray(x, dtype=np.float32) for x in shares] + [np.array([], dtype=np.float32)])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number, keyword, share) of every entry of the rows."""
        size = self.size[rows]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[rows], size)
        return np.repeat(np.arange(len(rows)), size), self.ids[at], self.shares[at]


def _means(keywords: np.ndarray, n: int, row: np.ndarray, ids: np.ndarray, shares: np.ndarray) -> np.ndarray:
    out = np.zeros((n, keywords.shape[1]), dtype=np.float32)
    if len(row):
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[begin]] = np.add.reduceat(keywords[ids] * shares[:, None], begin, axis=0)
    return out


class _Adam:
    """Adam with weight decay, on a copy of the weights; of the two tables only the rows in use are moved.

    The layers, and behind them the rows that a mini-batch uses, lie in one array, with their moments and gradients in others
    like it: a step is done on all of them at once. Units that are dead for good can be left out (drop).
    """

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: float):
        self.rate, self.decay, self.t = rate, decay, 0
        self.n_users, self.dim = weights["users"].shape
        table = np.concatenate([weights["users"], weights["keywords"]])
        self.tables = table, np.zeros_like(table), np.zeros_like(table)
        layers = [np.concatenate([weights[f"w{no}"], weights[f"b{no}"]]) for no in (1, 2, 3)]
        self.shapes, self.units = [x.shape for x in layers], [np.arange(x.shape[1]) for x in layers]
        self._lay(layers, *[[np.zeros_like(x) for x in layers] for _ in range(2)])
        self.rows, self.n = np.array([], dtype=np.int64), 0

    def _lay(self, *sets: list[np.ndarray]) -> None:
        """Lay out the layers: weights and two moments; gradients and space are beside them."""
        ends = np.cumsum([x.size for x in sets[0]]).tolist()
        self.size, self.places = ends[-1], [(end - x.size, x.shape) for x, end in zip(sets[0], ends)]
        self._hold([np.concatenate([x.ravel() for x in layers]) for layers in sets] + [np.zeros(self.size, dtype=sets[0][0].dtype) for _ in range(2)])

    def _hold(self, held: list[np.ndarray]) -> None:
        self.held = held
        self.layers = [[x[at : at + a * b].reshape(a, b) for at, (a, b) in self.places] for x in held]

    def take(self, users: np.ndarray, keywords: np.ndarray) -> None:
        """Lay out the rows of a mini-batch, distinct in either table."""
        self.rows, self.n = np.concatenate([users, keywords + self.n_users]), len(users)
        self.end = self.size + len(self.rows) * self.dim
        if self.end > len(self.held[0]):
            self._hold([np.concatenate([x[: self.size], np.zeros(2 * (self.end - self.size), dtype=x.dtype)]) for x in self.held])
        self.taken = [x[self.size : self.end].reshape(-1, self.dim) for x in self.held[:4]]
        for table, rows in zip(self.tables, self.taken):
            table.take(self.rows, axis=0, out=rows, mode="clip")

    def layer(self, no: int, of: int = 0) -> np.ndarray:
        """The weights (a moment with of=1 or 2, their gradients with of=3) of layer 1, 2 or 3; its last row is what is added."""
        return self.layers[of][no - 1]

    def drop(self) -> None:
        """Leave units out whose weights on either side, and the means that move those, are all 0: nothing can reach them, nor they anything."""
        sets = [[self.layer(no, of) for no in (1, 2, 3)] for of in range(3)]
        used = [np.logical_or.reduce([(x[no] != 0).any(0) | (x[no + 1][:-1] != 0).any(1) for x in sets[:2]]) for no in (0, 1)]
        if not all(u.all() for u in used):
            (one, two), (one_up, two_up) = used, [np.append(u, True) for u in used]
            self.units = [self.units[0][one], self.units[1][two], self.units[2]]
            self._lay(*[[x[0][:, one], x[1][one_up][:, two], x[2][two_up]] for x in sets])

    def used(self, of: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The rows of users and of keywords, or their gradients."""
        return self.taken[of][: self.n], self.taken[of][self.n :]

    def move_all(self) -> None:
        self._move(slice(0, self.end))

    def move(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """Move the weights of one name; grad is their part of the gradients."""
        if name in ("users", "keywords"):
            begin = self.size + self.n * self.dim * (name == "keywords")
        else:
            at, (high, wide) = self.places[int(name[1]) - 1]
            begin = at + (high - 1) * wide * (name[0] == "b")
        self._move(slice(begin, begin + grad.size))

    def _move(self, at: slice) -> None:
        w, m, v, g, space = (x[at] for x in self.held)
        far, level = 1 - 0.9**self.t, (1 - 0.999**self.t) ** 0.5
        np.multiply(w, self.decay, out=space)
        g += space
        m *= 0.9  # ten times the mean of gradients, and a thousand times that of squares
        m += g
        g *= g
        v *= 0.999
        v += g
        np.sqrt(v, out=g)
        g += 1e-8 * level * 1000**0.5
        np.divide(m, g, out=g)
        g *= self.rate * level / far * 10**0.5
        w -= g

    def clear(self) -> None:
        """Set weights of the layers to 0 that have decayed to nothing: what they come to next costs a processor many times as much."""
        for x, least in zip(self.held, (NOTHING, NOTHING / 100)):
            x = x[: self.size]
            x[np.abs(x) < least] = 0

    def put(self) -> None:
        """Take the rows of the mini-batch back into their tables."""
        for table, rows in zip(self.tables, self.taken):
            table[self.rows] = rows

    def flat(self) -> np.ndarray:
        """All weights, as of Network.flat()."""
        layers, above = [np.zeros(shape, dtype=self.held[0].dtype) for shape in self.shapes], np.arange(self.shapes[0][0])
        for no, (x, units) in enumerate(zip(layers, self.units), 1):
            x[np.ix_(above, units)] = self.layer(no)
            above = np.append(units, x.shape[1])
        return np.concatenate([x.ravel() for x in (self.tables[0], *layers)])


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, 0 or more, in order, and where each was: sorting both as one number is faster than argsort."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 62:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = np.sort(keys << bits | np.arange(len(keys)))
    return both >> bits, both & ((1 << bits) - 1)


def _mini_batches(u: np.ndarray, label: np.ndarray, bag: tuple, batch: int) -> Iterator[tuple]:
    """Mini-batches of the examples in order: distinct users, where each one's examples begin, each example's place among them, labels, distinct keywords, and shares with their places in a matrix of examples by keywords.

    What is sorted and counted for that is so for all the mini-batches at once. Within one, examples are ordered by user.
    """
    (row, ids, shares), n = bag, len(u)
    cut = np.arange(0, n + batch, batch).clip(max=n)
    of = np.arange(n) // batch
    key = of * (int(u.max(initial=0)) + 1) + u
    key, order = _sorted(key)
    u, label = u[order], label[order]
    first = np.ones(n, dtype=bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    begin, distinct = np.flatnonzero(first), np.cumsum(first) - 1
    user_cut = np.searchsorted(begin, cut)
    users, at_user = u[begin], distinct - user_cut[of]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    row, many = rank[row], int(ids.max(initial=0)) + 1
    own = row // batch
    word, back = _sorted(own * many + ids)
    new = np.ones(len(word), dtype=bool)
    np.not_equal(word[1:], word[:-1], out=new[1:])
    used, at = word[new], np.empty(len(word), dtype=np.int64)
    at[back] = np.cumsum(new) - 1
    word_cut, entry_cut = np.searchsorted(used, np.arange(len(cut)) * many), np.searchsorted(own, np.arange(len(cut)))
    words, width = used % many, np.diff(word_cut)
    place = (row - own * batch) * width[own] + at - word_cut[own]
    cut, user_cut, word_cut, entry_cut = (x.tolist() for x in (cut, user_cut, word_cut, entry_cut))
    for i in range(len(cut) - 1):
        mine, entries = slice(cut[i], cut[i + 1]), slice(entry_cut[i], entry_cut[i + 1])
        people = slice(user_cut[i], user_cut[i + 1])
        yield users[people], begin[people] - cut[i], at_user[mine], label[mine], words[word_cut[i] : word_cut[i + 1]], place[entries], shares[entries]


def _gradients(adam: _Adam, mini: tuple, kept: np.ndarray | None, share: float) -> np.ndarray:
    """Logits of a mini-batch, its rows taken and its gradients laid into adam. kept: 1 for each unit of the first layer that isn't dropped, a share of all."""
    users, begin, at_user, label, words, place, shares = mini
    adam.take(users, words)
    (own, w_words), (w1, w2, w3) = adam.used(), (adam.layer(no) for no in (1, 2, 3))
    (g_users, g_words), (n, dim, kind) = adam.used(3), (len(label), adam.dim, w1.dtype)
    parts = np.zeros(n * len(words), dtype=kind)
    np.add.at(parts, place, shares.astype(kind, copy=False))
    parts = parts.reshape(n, len(words))
    x, a1, a2 = (np.empty((n, len(w)), dtype=kind) for w in (w1, w2, w3))  # a last number of 1 meets a layer's last row
    x[:, :dim] = own if len(users) == n else own[at_user]
    np.matmul(parts, w_words, out=x[:, dim:-1])
    x[:, -1], a1[:, -1], a2[:, -1] = 1, share, 1
    in1, in2 = a1[:, :-1], a2[:, :-1]
    np.maximum(x @ w1, 0, out=in1)
    if kept is not None:
        in1 *= kept
    z2 = a1 @ w2
    z2 *= kind.type(1 / share)
    np.maximum(z2, 0, out=in2)
    s = (a2 @ w3)[:, 0]
    g = ((1 / (1 + np.exp(-s)) - label) / n).astype(kind, copy=False)[:, None]
    g2 = g * w3[:-1, 0]
    g2 *= in2 > 0
    np.matmul(a2.T, g, out=adam.layer(3, 3))
    g2 *= kind.type(1 / share)
    np.matmul(a1.T, g2, out=adam.layer(2, 3))
    g1 = g2 @ w2[:-1].T
    g1 *= in1 > 0
    np.matmul(x.T, g1, out=adam.layer(1, 3))
    gx = g1 @ w1[:-1].T
    if len(users) == n:
        g_users[:] = gx[:, :dim]
    else:
        np.add.reduceat(gx[:, :dim], begin, axis=0, out=g_users)
    np.matmul(parts.T, gx[:, dim:], out=g_words)
    adam.t += 1
    return s


def _kept(n: int, width: int, dropout: float, rng: np.random.Generator, kind: type) -> tuple[np.ndarray | None, float]:
    """1 for what is kept of n rows of so many units, 0 for what is dropped, to 1/65536; and what share that is of all."""
    dropped = round(dropout * 65_536)
    if not dropped:
        return None, 1.0
    drawn = rng.bit_generator.random_raw(-(-n * width // 4)).view(np.uint16)[: n * width].reshape(n, width)
    return (drawn >= dropped).astype(kind), 1 - dropped / 65_536


def _loss(s: np.ndarray, label: np.ndarray) -> float:
    return float(np.sum(np.logaddexp(0, s) - label * s))


def _step(adam: _Adam, u: np.ndarray, label: np.ndarray, bag: tuple, dropout: float, rng: np.random.Generator) -> float:
    """One mini-batch by itself: the loss, and the weights moved against its gradient, name by name."""
    mini = next(_mini_batches(u, label, bag, len(u)))
    s = _gradients(adam, mini, *_kept(len(u), adam.layer(1).shape[1], dropout, rng, adam.held[0].dtype))
    for name, grad, rows in zip(("users", "keywords"), adam.used(3), (mini[0], mini[4])):
        adam.move(name, grad, rows)
    for no in (1, 2, 3):
        adam.move(f"w{no}", adam.layer(no, 3)[:-1])
        adam.move(f"b{no}", adam.layer(no, 3)[-1:])
    adam.put()
    return _loss(s, mini[3])


def _pass(adam: _Adam, u: np.ndarray, label: np.ndarray, item: np.ndarray, bags: _Bags, batch: int, dropout: float, rng: np.random.Generator) -> float:
    """The examples once, in order, mini-batch by mini-batch: the sum of losses. item: each example's place in bags."""
    loss = 0.0
    for begin in range(0, len(u), AHEAD * batch):
        adam.drop()
        at = slice(begin, begin + AHEAD * batch)
        kept, share = _kept(len(u[at]), adam.layer(1).shape[1], dropout, rng, adam.held[0].dtype)
        done, logits, labels = 0, [], []
        for mini in _mini_batches(u[at], label[at], bags.of(item[at]), batch):
            n = len(mini[3])
            logits.append(_gradients(adam, mini, None if kept is None else kept[done : done + n], share))
            labels.append(mini[3])
            adam.move_all()
            adam.put()
            done += n
            if adam.t % 8 == 1:
                adam.clear()
        loss += _loss(np.concatenate(logits), np.concatenate(labels))
    return loss


def train(rows: DataFrame, net: Network, epochs: int = 15, batch: int = 64, rate: float = 0.005, dropout: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Network:
    """The network trained on rows of packed() or examples(), labels 0 or 1, for `epochs` passes over all of them. No rows leave it as it is.

    There are as many copies as cores, or partitions of a shuffle if those are fewer; an epoch's copies and the network that was
    sent out are removed from disk before the next begins.
    """
    spark = rows.sparkSession
    if "codes" not in rows.columns:
        rows = rows.withColumn("codes", F.array((F.col("u") * 2 + F.col("label")).cast("int")))
    key = F.xxhash64(*[c for c in ("user_id", "item_id", "number", "codes") if c in rows.columns])
    copies_at_once = min(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    placed = rows.select("ids", "shares", "codes", key.alias("key")).repartition(copies_at_once, "key").sortWithinPartitions("key", "codes", "ids", "shares")
    with short_shuffles(spark):
        return _train(cut_lineage(placed.drop("key")), net, epochs, batch, rate, dropout, decay, seed)


def _train(rows: DataFrame, net: Network, epochs: int, batch: int, rate: float, dropout: float, decay: float, seed: int) -> Network:
    spark = rows.sparkSession
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(net)

        def work(batches: Iterator[pd.DataFrame], shared=shared, epoch=epoch) -> Iterator[pd.DataFrame]:
            adam, part = _Adam(shared.value.weights, rate, decay), TaskContext.get().partitionId()
            rng, loss, seen = np.random.Generator(np.random.SFC64([seed, epoch, part])), 0.0, 0
            for frame in batches:
                bags, codes = _Bags(frame["ids"], frame["shares"]), np.concatenate([*frame["codes"], np.array([], dtype=np.int32)]).astype(np.int64)
                item = np.repeat(np.arange(len(frame)), [len(c) for c in frame["codes"]])
                order = rng.permutation(len(codes))
                codes, item = codes[order], item[order]
                loss += _pass(adam, codes >> 1, (codes & 1).astype(np.float32), item, bags, batch, dropout, rng)
                seen += len(codes)
            if seen:
                flat = adam.flat()
                cut = range(0, len(flat), CHUNK)
                yield pd.DataFrame({"part": part, "chunk": range(len(cut)), "n": seen, "loss": loss, "body": [flat[a : a + CHUNK].tobytes() for a in cut]})

        def average(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("part")
            values = np.stack([np.frombuffer(b, dtype=np.float32) for b in group["body"]]).astype(float)
            n = group["n"].to_numpy(dtype=float)
            return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "loss": [group["loss"].sum() / n.sum()], "body": [(n @ values / n.sum()).astype(np.float32).tobytes()]})

        copies = rows.mapInPandas(work, "part int, chunk int, n long, loss double, body binary")
        chunks = sorted(copies.groupBy("chunk").applyInPandas(average, "chunk int, loss double, body binary").collect(), key=lambda r: r["chunk"])  # one network
        if not chunks:
            shared.destroy(blocking=True)
            return net
        flat, loss = np.empty(sum(len(r["body"]) for r in chunks) // 4, dtype=np.float32), chunks[0]["loss"]
        for r in chunks:
            at = r["chunk"] * CHUNK
            flat[at : at + len(r["body"]) // 4] = np.frombuffer(r["body"], dtype=np.float32)
        net = net.like(flat)
        net.losses.append(loss)
        del chunks, flat, r
        shared.destroy(blocking=True)
        spark.sparkContext._jvm.System.gc()  # the epoch's network, some times over, is in the driver's heap
    return net


def scores(net: Network, users: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """Scores, 0 to 1, of every user place with every item's mean keyword vector."""
    w = net.weights
    dim = w["users"].shape[1]
    left, right = w["users"][users] @ w["w1"][:dim] + w["b1"], bags @ w["w1"][dim:]
    out = np.empty((len(users), len(bags)))
    for r in range(len(users)):
        hidden = np.maximum(np.maximum(left[r] + right, 0) @ w["w2"] + w["b2"], 0)
        out[r] = 1 / (1 + np.exp(-(hidden @ w["w3"] + w["b3"])[:, 0].astype(float)))
    return out


def recommend(net: Network, asked: DataFrame, lists: DataFrame, seen: DataFrame | None, k: int = 5, block: int | None = None) -> DataFrame:
    """(query_id, rk, item_id, score): the k items of highest score to each asked user (user_id, u), those in seen (query_id, item_id) left out.

    lists: (item_id, ids, shares). Ties, to 9 places, go to the smaller id. Asked users are taken in blocks, as in the other rankings.
    """
    spark, net = lists.sparkSession, net.live()
    asked = cut_lineage(asked.select(F.col("user_id").cast("long").alias("query_id"), net.user_place(F.col("u")).alias("u")).where("query_id is not null"))
    items = lists.select(F.col("item_id").cast("long").alias("item_id"), "ids", "shares")

    def score_block(part: DataFrame) -> DataFrame:
        rows = sorted((r["query_id"], r["u"]) for r in part.collect())  # one block
        shared = spark.sparkContext.broadcast((net, np.array([q for q, _ in rows], dtype=np.int64), np.array([u for _, u in rows], dtype=np.int64)))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            net, qids, places = shared.value
            best = _Best(len(qids), k)
            for frame in batches:
                frame = frame.sort_values("item_id")
                if not len(frame) or not len(qids):
                    continue
                own, bags = frame["item_id"].to_numpy(dtype=np.int64), _Bags(frame["ids"], frame["shares"])
                means = _means(net.weights["keywords"], len(own), *bags.of(np.arange(len(own))))
                step = max(1, CELLS // len(own))
                for begin in range(0, len(qids), step):
                    found = scores(net, places[begin : begin + step], means)
                    _hide(found, qids[begin : begin + step], frame["seen_by"])
                    best.add(begin, found, own)
            yield best.rows(qids)

        return _seen_by(items, seen, part.select("query_id")).mapInPandas(work, "query_id long, item_id long, score double")

    return _ranked(_union([score_block(b) for b in _blocks(asked, "query_id", len(net.weights["users"][0]), block)]), k)


def save(net: Network, spark: SparkSession, path: str) -> None:
    rows = [(no, name, list(w.shape), w.ravel().tolist()) for no, (name, w) in enumerate(net.weights.items())]
    spark.createDataFrame(rows, "no int, name string, shape array<int>, weights array<float>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["no"])  # one network
    return Network({r["name"]: np.array(r["weights"], dtype=np.float32).reshape(r["shape"]) for r in rows})
