"""The content network: gradients against differences, training, ranking against brute force, saving."""

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from citeloom.operators import network, recommend


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = network.Network.new(5, 6, 4, (8, 5), seed=1)
    net = network.Network({k: w.astype(np.float64) for k, w in net.weights.items()})
    u, label = np.array([0, 3, 3]), np.array([1.0, 0.0, 1.0])
    bag = np.array([0, 0, 2]), np.array([1, 2, 6]), np.array([0.5, 0.5, 1.0])

    class Record(network._Adam):
        def __init__(self, w):
            super().__init__(w, 0.0, 0.0)
            self.grads = {k: np.zeros_like(x) for k, x in w.items()}

        def move(self, name, grad, rows=slice(None)):
            self.grads[name][rows] += grad

    def loss(w):
        return network._step(Record(w), u, label, bag, 0.0, rng) / 3

    seen = Record(net.weights)
    network._step(seen, u, label, bag, 0.0, rng)
    for name, w in net.weights.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)]:
            keep, small = w[at], 1e-4
            w[at] = keep + small
            up = loss(net.weights)
            w[at] = keep - small
            down = loss(net.weights)
            w[at] = keep
            assert abs((up - down) / (2 * small) - seen.grads[name][at]) < 1e-3


def test_training_ranking_and_saving(spark, rows, tmp_path):
    rng = random.Random(1)
    pairs = [(u, i, float(i % 2 == u % 2)) for u in range(12) for i in range(20) if rng.random() < 0.7]
    bags = spark.createDataFrame([(i, 1 + i % 2, 2) for i in range(19)] + [(0, 3, 1)], "item_id long, keyword_id long, weight long")
    users = spark.createDataFrame([(u, u) for u in range(12)], "user_id long, u long")
    net = network.Network.new(12, 3, 8, (16, 8))
    lists = network.bag_lists(bags, net)
    assert {r["item_id"]: (r["ids"], [round(x, 4) for x in r["shares"]]) for r in lists.collect()}[0] == ([1, 3], [0.6667, 0.3333])
    assert {r["item_id"]: r["shares"] for r in network.bag_lists(bags, net, False).collect()}[0] == [0.5, 0.5]
    data = network.examples(spark.createDataFrame(pairs, "user_id long, item_id long, label double"), users, lists, net)
    trained = network.train(data, net, epochs=30, batch=8, rate=0.02, dropout=0.1)
    assert len(trained.losses) == 30 and trained.losses[-1] < 0.3 < trained.losses[0]
    again = network.train(data, net, epochs=2, batch=8, rate=0.02, dropout=0.1)
    assert np.allclose(again.losses, trained.losses[:2])
    seen = spark.createDataFrame([(0, 2), (0, 4), (99, 1)], "query_id long, item_id long")
    got = [tuple(r)[:3] for r in network.recommend(trained, users.where("user_id < 3"), lists, seen, 3, block=2).collect()]
    means = {r["item_id"]: sum(s * trained.weights["keywords"][k] for k, s in zip(r["ids"], r["shares"])) for r in lists.collect()}
    for u in range(3):
        s = {i: network.scores(trained, np.array([u]), np.array([m]))[0, 0] for i, m in means.items() if (u, i) not in {(0, 2), (0, 4)}}
        best = {round(x, 6) for x in sorted(s.values())[-3:]}
        assert {round(s[i], 6) for q, _, i in got if q == u} <= best and sum(q == u for q, _, _ in got) == 3
        assert all(i % 2 == u % 2 for q, _, i in got if q == u)
    network.save(trained, spark, str(tmp_path / "net"))
    loaded = network.load(spark, str(tmp_path / "net"))
    assert all(np.array_equal(loaded.weights[k], w) for k, w in trained.weights.items())
    assert network.train(data.limit(0), net, 1) is net and network.recommend(net, users.limit(0), lists, None).count() == 0


def test_places_are_bounded(spark):
    net = network.Network.new(1000, 1000, 4, (4, 4), places=10)
    assert net.weights["users"].shape == (10, 4) and net.weights["keywords"].shape == (11, 4)
    got = spark.range(1, 1001).select(net.user_place(F.col("id")).alias("u"), net.keyword_place(F.col("id")).alias("k")).agg(F.min("u"), F.max("u"), F.min("k"), F.max("k")).first()
    assert tuple(got) == (0, 9, 1, 10)


def _kept(spark):
    """Bytes of shuffles and of what was sent out, on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    files = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in files if f.getName().startswith(("shuffle_", "broadcast_")))


def test_epochs_leave_nothing_on_disk(spark):
    bags = spark.createDataFrame([(i, 1 + i, 2) for i in range(20)], "item_id long, keyword_id long, weight long")
    net = network.Network.new(2000, 20, 64)
    data = network.examples(spark.range(400).selectExpr("id as user_id", "id % 20 as item_id", "id % 2 as label"), spark.range(400).selectExpr("id as user_id", "id as u"), network.bag_lists(bags, net), net)
    before = _kept(spark)
    assert len(network.train(data, net, epochs=6).losses) == 6
    for _ in range(50):  # files are removed in the background
        if (left := _kept(spark) - before) < net.flat().nbytes:
            break
        time.sleep(0.1)
    assert left < net.flat().nbytes


def test_drawn_in_place_as_by_joins(spark):
    rng = random.Random(4)
    pairs = {(u, 3 * i) for u in range(60) for i in range(30) if rng.random() < u / 59}  # from no item to all of them
    number = {x: no for no, x in enumerate(sorted({i for _, i in pairs}))}
    frame = spark.createDataFrame(sorted(pairs), "user_id long, item_id long")
    want = Counter((r["user_id"], number[r["item_id"]]) for r in recommend.training_negatives(frame).collect())
    rows = spark.createDataFrame([(u, i, 1000 + u, number[i]) for u, i in pairs], "user_id long, item_id long, u long, number long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)  # a user's rows are in several batches
    try:
        got = recommend.training_numbers(rows, len(number)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r["u"] - 1000, r["number"]) for r in got if r["label"] == 0) == want and sum(want.values()) > 2000
    assert Counter((r["u"] - 1000, r["number"]) for r in got if r["label"] == 1) == Counter((u, number[i]) for u, i in pairs)
    assert recommend.training_numbers(rows.limit(0), 0).count() == 0


def test_lists_stand_once_for_many_examples(spark, monkeypatch):
    monkeypatch.setattr(network, "TOGETHER", 4)
    net = network.Network.new(30, 6, 4, (4, 4))
    examples = [(u, i, int((u + i) % 3 == 0)) for u in range(30) for i in range(u % 5 + 1)]
    lists = spark.createDataFrame([(i, [1, i + 1], [0.5, 0.5]) for i in range(1, 5)], "number long, ids array<int>, shares array<float>")
    got = network.packed(spark.createDataFrame(examples * 2, "u long, number long, label int"), lists, net).collect()
    assert Counter((c >> 1, r["number"], c & 1) for r in got for c in r["codes"]) == Counter(examples * 2)
    assert all(r["ids"] == ([1, r["number"] + 1] if r["number"] else []) and len(r["ids"]) == len(r["shares"]) for r in got)
    assert len(got) < 0.4 * 2 * len(examples)


def test_one_copy_of_the_weights():
    net = network.Network.new(50, 20, 4, (4, 4))
    flat = net.flat()
    assert all(np.shares_memory(w, flat) for w in net.like(flat).weights.values())


def test_mini_batches_against_plain_steps():
    rng = np.random.default_rng(5)
    net = network.Network.new(6, 9, 4, (8, 5), seed=2)
    ids = [np.sort(rng.integers(1, 10, rng.integers(0, 5))) for _ in range(7)]  # empty lists, and places that several keywords share
    bags = network._Bags(ids, [np.full(len(x), 1 / max(1, len(x)), dtype=np.float32) for x in ids])
    u, item, label = rng.integers(0, 6, 43), rng.integers(0, 7, 43), rng.integers(0, 2, 43).astype(np.float32)
    w = {k: x.astype(float) for k, x in net.weights.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    loss = 0.0
    for t, begin in enumerate(range(0, 43, 5), 1):
        grads = {k: np.zeros_like(x) for k, x in w.items()}
        used = {"users": set(), "keywords": set()}
        mine = range(begin, min(43, begin + 5))
        for e in mine:
            words = ids[item[e]]
            x = np.concatenate([w["users"][u[e]], w["keywords"][words].sum(0) / max(1, len(words))])
            z1 = x @ w["w1"] + w["b1"][0]
            z2 = np.maximum(z1, 0) @ w["w2"] + w["b2"][0]
            s = float(np.maximum(z2, 0) @ w["w3"][:, 0] + w["b3"][0, 0])
            loss += np.log1p(np.exp(s)) - label[e] * s
            g = (1 / (1 + np.exp(-s)) - label[e]) / len(mine)
            g2 = g * w["w3"][:, 0] * (z2 > 0)
            g1 = w["w2"] @ g2 * (z1 > 0)
            gx = w["w1"] @ g1
            for name, grad in (("w3", np.maximum(z2, 0)[:, None] * g), ("b3", g), ("w2", np.outer(np.maximum(z1, 0), g2)), ("b2", g2), ("w1", np.outer(x, g1)), ("b1", g1)):
                grads[name] += grad
            grads["users"][u[e]] += gx[:4]
            used["users"].add(u[e])
            for k in words:
                grads["keywords"][k] += gx[4:] / len(words)
                used["keywords"].add(k)
        for name in w:
            at = sorted(used[name]) if name in used else slice(None)
            g = grads[name][at] + 1e-3 * w[name][at]
            m[name][at] = 0.9 * m[name][at] + 0.1 * g
            v[name][at] = 0.999 * v[name][at] + 0.001 * g**2
            w[name][at] -= 0.01 * m[name][at] / (1 - 0.9**t) / (np.sqrt(v[name][at] / (1 - 0.999**t)) + 1e-8)
    together, apart = (network._Adam(net.weights, 0.01, 1e-3) for _ in range(2))
    found = network._pass(together, u, label, item, bags, 5, 0.0, rng)
    single = sum(network._step(apart, u[b : b + 5], label[b : b + 5], bags.of(item[b : b + 5]), 0.0, rng) for b in range(0, 43, 5))
    assert abs(found - loss) < 1e-3 and abs(single - loss) < 1e-3
    want = np.concatenate([x.ravel() for x in w.values()])
    assert np.allclose(together.flat(), want, atol=2e-4) and np.allclose(apart.flat(), want, atol=2e-4)
    assert np.array_equal(net.flat(), network.Network.new(6, 9, 4, (8, 5), seed=2).flat())


def test_dropped_units_keep_their_mean():
    kept, share = network._kept(4000, 128, 0.3, np.random.default_rng(1), np.float32)
    assert set(np.unique(kept)) == {0, 1} and abs(share - 0.7) < 1e-5 and abs(kept.mean() - 0.7) < 0.005 and np.abs(kept.mean(0) - 0.7).max() < 0.05
    assert network._kept(4, 128, 0.0, np.random.default_rng(1), np.float32) == (None, 1.0)


def test_dead_units_come_to_nothing(spark):
    bags = spark.createDataFrame([(i, 1 + i, 2) for i in range(20)], "item_id long, keyword_id long, weight long")
    net = network.Network.new(40, 20, 8, (16, 8))
    net.weights["w1"][:, :9], net.weights["w2"][:9] = 1e-39, -1e-39  # what units that nothing reaches decay to, a processor's slowest numbers
    data = network.examples(spark.range(400).selectExpr("id % 40 as user_id", "id % 20 as item_id", "id % 2 as label"), spark.range(40).selectExpr("id as user_id", "id as u"), network.bag_lists(bags, net), net)
    for name, w in network.train(data, net, epochs=1, batch=8).weights.items():
        assert not np.any((w != 0) & (np.abs(w) < 1e-20)), name


def test_dropped_dead_units_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    net = network.Network.new(12, 9, 4, (8, 5), seed=2)
    for unit in (1, 6):
        net.weights["w1"][:, unit] = net.weights["w2"][unit] = 0
    net.weights["w2"][:, 3] = net.weights["w3"][3] = 0
    net.weights["w1"][:, 2] = 0  # still moved from behind
    bags = network._Bags([[1 + i] for i in range(9)], [[1.0] for _ in range(9)])
    u, item, label = rng.integers(0, 12, 80), rng.integers(0, 9, 80), rng.integers(0, 2, 80).astype(np.float32)
    monkeypatch.setattr(network, "AHEAD", 2)
    short, long = (network._Adam(net.weights, 0.01, 1e-3) for _ in range(2))
    network._pass(short, u, label, item, bags, 8, 0.0, rng)
    assert short.units[0].tolist() == [0, 2, 3, 4, 5, 7] and short.units[1].tolist() == [0, 1, 2, 4]
    monkeypatch.setattr(network._Adam, "drop", lambda self: None)
    network._pass(long, u, label, item, bags, 8, 0.0, rng)
    assert len(long.units[0]) == 8 and short.flat().shape == net.flat().shape and np.allclose(short.flat(), long.flat(), atol=1e-6)
    gone = network._Adam({k: np.zeros_like(w) for k, w in net.weights.items()}, 0.01, 1e-3)
    monkeypatch.undo()
    assert network._pass(gone, u, label, item, bags, 8, 0.3, rng) > 0 and not len(gone.units[0])


def test_live_units_score_as_all():
    net = network.Network.new(12, 9, 4, (8, 5), seed=2)
    net.weights["w1"][:, 1] = net.weights["w2"][4] = 0
    net.weights["w1"][:, 6], net.weights["b1"][0, 6] = 0, 0.5  # its bias goes on
    net.weights["w2"][:, 3] = net.weights["w3"][2] = 0
    few, means = net.live(), np.random.default_rng(1).random((7, 4), dtype=np.float32)
    assert few.weights["w1"].shape == (8, 6) and few.weights["w2"].shape == (6, 3) and net.weights["w1"].shape == (8, 8)
    assert np.allclose(network.scores(few, np.arange(12), means), network.scores(net, np.arange(12), means), atol=1e-6)


def test_sorted_with_places():
    for most in (1, 50, 2**61):  # the last has no room for places beside the keys
        keys = np.random.default_rng(2).integers(0, most, 300)
        got, order = network._sorted(keys)
        assert np.array_equal(order, np.argsort(keys, kind="stable")) and np.array_equal(got, keys[order])
    assert [len(x) for x in network._sorted(np.array([], dtype=np.int64))] == [0, 0]


def test_copies_leave_in_few_rows():
    assert len(range(0, len(network.Network.new(65_536, 30_000).flat()), network.CHUNK)) < 100
