"""Problems 1, 2, 3 and 8 against brute force on small tables."""

import random
from collections import Counter
from itertools import combinations

import pytest

from citeloom.llm import canonical, cooccurrence, mixing, term_frequency

FIELDS = "node_idx long, domain array<string>, method array<string>, term string"


def norm(t):
    t = " ".join((t or "").split()).lower()
    return t or None


def test_terms_against_brute_force(spark, rows):
    rng = random.Random(1)
    words = ["Common", " common ", "a b", "A  b", "", None, "  ", "x" * 5000] + [f"w{i}" for i in range(400)]
    data = [(rng.choice([None, 7, 7, 7, *range(60)]), rng.choice([None, [], [rng.choice(words) for _ in range(12)]]), [rng.choice(words)], "clash") for _ in range(400)]
    df = spark.createDataFrame(data, FIELDS)
    uses, records = Counter(), {}
    for node, *lists in data:
        for field, terms in zip(("domain", "method"), lists):
            for t in terms or []:
                if node is not None and norm(t):
                    uses[field, norm(t)] += 1
                    records.setdefault((field, norm(t)), set()).add(node)
    n = len({d[0] for d in data} - {None})
    want = [(f, t, uses[f, t], len(r), "rare" if len(r) < 3 else "common" if len(r) * 10 > n else None) for (f, t), r in records.items()]
    assert rows(term_frequency.term_frequencies(df, "node_idx", ["domain", "method"])) == sorted(want, key=repr)
    assert term_frequency.term_frequencies(df.limit(0), "node_idx", ["domain"]).count() == 0


def test_trie_bursts_and_keeps_every_string():
    rng = random.Random(2)
    trie, want = term_frequency.BurstTrie(4), Counter()
    for _ in range(3000):
        s = "".join(rng.choice("ab日") for _ in range(rng.randrange(0, 9)))
        trie.add(s, 2, 1)
        want[s] += 2
    got = {p + s: c[0] for p, node in trie.containers() for s, c in node.items()}
    assert got == dict(want) and max(len(c) for _, c in trie.containers()) <= 5
    assert [p for p, _ in trie.containers()] == sorted(p for p, _ in trie.containers())


def test_routes_split_heavy_prefixes(spark):
    blocks = spark.createDataFrame([("f", "ab", 600, b""), ("f", "ac", 300, b""), ("f", "b", 5, b""), ("f", "", 3, b"")], term_frequency.BLOCK)
    heavy = term_frequency.heavy_prefixes(blocks, routes=10)
    assert heavy == {"f": {"", "a", "ab", "ac"}}
    assert term_frequency.route("abc", heavy["f"]) == "abc" and term_frequency.route("bzz", heavy["f"]) == "b" and term_frequency.route("ab", heavy["f"]) == "ab"
    deep = {"x" * k for k in range(30)}
    assert {term_frequency.route("x" * 24 + str(i), deep)[:25] for i in range(9)} == {"x" * 24 + "\0"}


def brute_pairs(items):
    baskets = {}
    for f, r, i in items:
        if r is not None and i is not None:
            baskets.setdefault((f, r), set()).add(i)
    single, pair = Counter(), Counter()
    for (f, _), s in baskets.items():
        single.update((f, i) for i in s)
        pair.update((f, *p) for p in combinations(sorted(s), 2))
    return single, pair


@pytest.mark.parametrize("bounds", [{}, {"min_shared": 3, "min_lift": 2}])
def test_pairs_against_brute_force(spark, rows, bounds):
    rng = random.Random(3)
    items = [(f, r, rng.choice("ABCDEFGHé日\U0001f642")) for f in ("m", "a") for r in range(40) for _ in range(rng.randrange(0, 6))]
    items += [("m", 99, f"big{i}") for i in range(200)] + [("m", 98, f"big{i}") for i in range(150)] + [("m", None, "A"), ("m", 5, None)]
    n = {"m": 45, "a": 41}
    df = spark.createDataFrame(items, "field_name string, record long, item string")
    got = rows(cooccurrence.pair_statistics(df, spark.createDataFrame(list(n.items()), "field_name string, n long"), **bounds).drop("lift", "n"))
    single, pair = brute_pairs(items)
    want = [(f, a, b, c, single[f, a], single[f, b]) for (f, a, b), c in pair.items() if c >= bounds.get("min_shared", 1) and n[f] * c >= bounds.get("min_lift", 0) * single[f, a] * single[f, b]]
    assert got == sorted(want, key=repr)


def test_similarity_join_against_brute_force(spark, rows):
    rng = random.Random(4)
    sets = lambda n: [(i, sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 9))})) for i in range(n)]
    x, y = sets(60), sets(40)
    frame = lambda s: spark.createDataFrame(s, "id long, features array<string>")
    for t in (0.4, 0.75, 1.0):
        want = [(i, j) for i, a in x for j, b in y if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= t - 1e-12]
        assert rows(canonical.similarity_join(frame(x), frame(y), t), "left_id", "right_id") == sorted(want, key=repr)


LIST = [(0, "Graph Mining", "GRMN"), (1, "Speech Processing", "SPPR"), (2, "Cloud Scheduling", "CLSC"), (3, "Document Layout Analysis", "DOCL")]
TYPED = {
    "graph mining": 0, "Mining, Graph": 0, "GraphMining": 0, "Graph Minning": 0, "GRMN": 0, "[GRMN] graph mining": 0, "Cloud Sched.": 2, "the area of Speech Processing": 1,
    "Doc. Layout Anal.": 3, "document_layout analysis ": 3, "Coal Mining": -1, "Cloud Physics": -1, "Speech Therapy": -1, "Graph Paper Design": -1, "n/a": -1, "x" * 100_000: -1,
}


def test_canonical_candidates(spark, rows):
    entries = spark.createDataFrame(LIST, "label_idx int, category string, short_code string")
    cands = [(9, t) for t in TYPED] + [(2, None), (77, "  "), (None, "")]
    data = [(1, cands), (1, cands), (2, None), (3, []), (4, [(0, "Graph Mining")])]
    df = spark.createDataFrame(data, "node_index long, topk_candidates array<struct<label_idx:int,category:string>>")
    got = rows(canonical.canonical_candidates(df, entries), "node_index", "cand_no", "label_idx")
    want = [(1, k + 1, v) for k, v in enumerate([*TYPED.values(), 2, -1, -1])]
    assert got == sorted(want, key=repr)
    assert canonical.canonical_candidates(df.limit(0), entries).count() == 0
    assert {r[2] for r in rows(canonical.canonical_candidates(df.where("node_index = 1"), entries.limit(0)), "node_index", "cand_no", "label_idx")} == {-1}


def brute_sainte_lague(weights, caps, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        q = [(w / (2 * g + 1), -i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if w > 0 and g < c]
        if not q:
            break
        got[-max(q)[1]] += 1
    return got


def test_apportionment_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 8)
        w = [rng.choice([0, rng.random(), 1.0]) for _ in range(n)]
        caps, seats = [rng.randrange(0, 30) for _ in range(n)], rng.randrange(0, 80)
        assert mixing.sainte_lague(w, caps, seats) == brute_sainte_lague(w, caps, seats)


def test_mix(spark, rows):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["red", "blue", "stone"]) for _ in range(rng.randrange(5, 60))), rng.choice(["web", "web", " Web", "book", "other", None])) for i in range(600)]
    docs += [(1000, None, "web"), (1001, "", "book"), (1002, "x " * 200, "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as n_tokens", "2 as shard")
    targets = spark.createDataFrame([("web", 0.5, 1), ("book", 0.4, 4), ("tiny", 0.08, 3), ("none", 0.02, 5)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(df, targets, total_tokens=12_000, block=64, shard_tokens=2_000)
    got = {r["source"]: r for r in report.collect()}
    assert got["none"]["used_tokens"] == 0 and got["none"]["missed_share"] == 0.02
    most = {"web": 1, "book": 4, "tiny": 3}
    used = Counter()
    for r in drawn.collect():
        assert 1 <= r["times"] <= most[r["source"]]
        used[r["source"]] += r["times"] * r["n_tokens"]
    assert used == {s: got[s]["used_tokens"] for s in used} and got["tiny"]["used_tokens"] == 3 * got["tiny"]["available_tokens"]
    assert abs(got["web"]["reached_share"] / got["book"]["reached_share"] - 0.5 / 0.4) < 0.05
    assert rows(mixing.mix(df, targets, total_tokens=12_000, block=64, shard_tokens=2_000)[0]) == rows(drawn)
    drawn, report = mixing.mix(df.limit(0), targets)
    assert drawn.count() == 0 and report.agg({"used_tokens": "sum"}).first()[0] == 0


def test_blocks_are_equal_and_no_token_is_used_too_often(spark):
    rng = random.Random(16)
    docs = [(i, " ".join(rng.choice(["red", "blue", "stone"]) for _ in range(rng.choice([1, 3, 40, 900]))), rng.choice(["web", "book"])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("web", 0.3, 1), ("book", 0.7, 3)], "source string, target_share double, max_repeats int")
    sizes = {r["doc_id"]: r["n_tokens"] for r in mixing.count_tokens(df, "text", ["doc_id"]).collect()}
    source = {d: s for d, _, s in docs}
    for total in (2_000, 30_000, 10**9):
        drawn, report = mixing.mix(df, targets, total_tokens=total, block=64, shard_tokens=4_000)
        rows = drawn.collect()
        blocks, uses = {}, Counter()
        for r in rows:
            key = r["source"], r["shard"], r["block"]
            assert source[r["doc_id"]] == r["source"] and blocks.setdefault(key, r["times"]) == r["times"]
            blocks[key] = r["times"]
            uses.update({(r["doc_id"], t): r["times"] for t in range(r["start_token"], r["start_token"] + r["n_tokens"])})
        assert all(0 <= t < sizes[d] and 1 <= n <= {"web": 1, "book": 3}[source[d]] for (d, t), n in uses.items())
        size = Counter()
        for r in rows:
            size[r["source"], r["shard"], r["block"]] += r["n_tokens"]
        assert max(size.values()) == 64 and sum(v < 64 for v in size.values()) <= len({k[:2] for k in size})
        for r in report.collect():
            assert r["used_tokens"] == sum(size[k] * n for k, n in blocks.items() if k[0] == r["source"]) and -64 * 3 * len({k[:2] for k in size}) < r["over_tokens"] <= 0
            if total == 10**9:
                assert r["used_tokens"] == r["available_tokens"] * r["max_repeats"]
