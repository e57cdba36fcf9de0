"""The reference's operators on hand-computed cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import parse
from citeloom.functions import text as T
from citeloom.functions.vectors import cosine, unit_score
from citeloom.operators import components, cost, evaluate, graph, keywords, models, numbering, recommend, tfidf, users
from citeloom.plans import core
from citeloom.sources import providers, readers, sinks
from citeloom.streaming import enrich


def test_tfidf_fixture(spark, rows):
    docs = [("d1", "State-of-the-art graph learning"), ("d2", "Graph neural graph"), ("d3", "neural learning 2020"), ("d4", "Graph graph sampling")]
    got = rows(tfidf.keywords(spark.createDataFrame(docs, "id string, text string"), "id", "text"))
    assert got == sorted([("d1", 1, "learning", 1.510826), ("d1", 2, "graph", 1.223144), ("d2", 1, "graph", 2.446287), ("d2", 2, "neural", 1.510826), ("d3", 1, "learning", 1.510826), ("d3", 2, "neural", 1.510826), ("d4", 1, "graph", 2.446287)], key=repr)


def test_tfidf_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (None, "alpha beta")], "id long, text string")
    assert tfidf.keywords(df, "id", "text").count() == 0
    assert tfidf.keywords(df.limit(0), "id", "text").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Abstract We study Abstract nets",), ("An Abstract machine",), (None,), ("none",)], "t string")
    assert [r[0] for r in df.select(T.strip_marker("t" and F.col("t"))).collect()] == ["We study Abstract nets", "An  machine", None, "none"]
    one = spark.range(1)
    assert one.select(T.clean_text(F.lit("Multi-Layer 3D\tnets!"))).first()[0] == "multilayer d\tnets"
    assert one.select(T.shortened_list(F.array(*[F.lit(x) for x in "abcd"]))).first()[0] == "a, b, c..."
    assert one.select(T.prompt_words(F.lit("Find GAN-based 3D Nets now"))).first()[0] == ["find", "nets", "now"]


EDGES = [(1, 2), (1, 3), (1, 3), (4, 1), (2, 1), (5, 5), (None, 1)]


def test_graph_context(spark, rows):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "idx long")
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    labels = spark.createDataFrame([(2, 0), (3, 1), (4, 1)], "idx long, label_idx long")
    near = graph.neighbours(edges)
    assert [tuple(r) for r in near.where("idx = 1").orderBy("pos").collect()] == [(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 4)]
    assert rows(graph.label_distribution(near, labels).where("idx = 1")) == [(1, 1, 0, 2, 4, 0.5), (1, 2, 1, 2, 4, 0.5)]
    assert rows(graph.label_distribution(graph.neighbours(edges, 2), labels).where("idx = 1"), "label_idx", "cnt", "total") == [(0, 1, 2), (1, 1, 2)]
    asked = spark.createDataFrame([(i,) for i in (1, 5, 6, 9)], "idx long")
    got = dict(rows(graph.citation_context(asked, nodes, edges, labels), "idx", "branch"))
    assert got == {1: "evidence", 5: "unlabeled", 6: "isolated", 9: "not_in_graph"}
    assert dict(rows(graph.edges_with_multiplicity(edges).where("src = 1"), "dst", "multiplicity")) == {2: 1, 3: 2}
    assert rows(graph.degrees(nodes, graph.simple_edges(edges)).where("idx in (1, 5, 6)")) == [(1, 2, 2), (5, 1, 1), (6, 0, 0)]
    names = spark.createDataFrame([(0, "A"), (1, "B")], "label_idx long, category string")
    text = dict(rows(graph.context_text(graph.citation_context(asked, nodes, edges, labels), graph.label_distribution(near, labels), names)))
    assert text[1] == "A (count=2, ratio=0.50); B (count=2, ratio=0.50)" and text[6] == "isolated"


@pytest.mark.parametrize("target", [0, 7, 40, 1000])
def test_forest_fire(spark, target):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)]
    nodes, table = spark.createDataFrame([(i,) for i in range(60)], "idx long"), spark.createDataFrame(edges, "src long, dst long")
    got = [tuple(r) for r in graph.forest_fire(nodes, table, target).collect()]
    assert len(got) == len({i for i, _ in got}) == min(target, 60)
    rounds = dict(got)
    # whoever burned with others of a round was lit by a node of an earlier one
    for i, r in got:
        if sum(1 for x in rounds.values() if x == r) > 1:
            assert any(d == i and rounds.get(s, 1 << 30) < r for s, d in edges)
    assert sorted(got) == sorted(map(tuple, graph.forest_fire(nodes, table, target).collect()))


def test_cost(spark):
    calls = spark.createDataFrame([(100, 20), (200, 40), (None, 0)], "input_tokens long, output_tokens long")
    r = cost.cost_summary(calls, 1000).first()
    assert (r["calls"], r["total_input_tokens"], r["total_output_tokens"], r["avg_input_tokens"], r["projected_output_tokens"], r["projected_cost"]) == (3, 300, 60, 100.0, 20000.0, 0.027)
    assert set(cost.cost_summary(calls.limit(0), 1000).first()) == {0, 0.0}


def test_evaluation(spark, rows):
    truth = {"r1": (3, [3, 1, 2]), "r2": (1, [0, 1, 2]), "r3": (5, [0, 1, 2, 5]), "r4": (5, [0, 4]), "r5": (None, [0, 1, 2]), "r6": (2, None)}
    data = [(n, t, c and [(x,) for x in c]) for n, (t, c) in truth.items()]
    df = spark.createDataFrame(data + data[:1], "node_index string, true_label_idx int, topk_candidates array<struct<label_idx:int>>")
    s = evaluate.scored(df)
    r = evaluate.accuracy(s.where("node_index <> 'r6'")).first()
    assert (r["n"], r["top1_acc"], r["top3_acc"], r["n_miss"]) == (4, 0.25, 0.5, 2)
    assert rows(evaluate.miss_confusion(s)) == sorted([(5, 0, 2), (2, None, 1)], key=repr)
    assert rows(evaluate.per_class(s), "true_idx", "total", "miss") == [(1, 1, 0), (2, 1, 1), (3, 1, 0), (5, 2, 2)]
    assert evaluate.accuracy(s.limit(0)).first()["top1_acc"] is None
    h = spark.createDataFrame([(0,), (0,), (2,), (None,)], "label int")
    assert rows(evaluate.label_histogram(h, "label")) == [(0, 2), (1, 0), (2, 1)]


def test_users(spark, rows):
    papers = [(10, ["Ann", " Bob ", "", None]), (11, ["Bob", "Ann", "Ann"]), (12, None), (None, ["Zed"]), (10, ["Ann", " Bob ", "", None])]
    authors = users.author_rows(spark.createDataFrame(papers, "node_idx long, authors array<string>"))
    reg = users.registry(authors)
    assert rows(reg) == [(0, "Ann"), (1, "Bob")]
    pairs = users.interactions(authors, reg)
    assert rows(pairs) == [(0, 10, 1), (0, 11, 2), (1, 10, 1), (1, 11, 1)]
    kw = spark.createDataFrame([(10, "graph"), (10, "learning"), (11, "graph"), (11, "neural")], "item_id long, keyword string")
    top = [tuple(r) for r in users.top_keywords(pairs, kw).orderBy("user_id", "rk").collect()]
    assert top == [(0, 1, "graph", 3), (0, 2, "neural", 2), (0, 3, "learning", 1), (1, 1, "graph", 2), (1, 2, "learning", 1), (1, 3, "neural", 1)]
    few = spark.createDataFrame([(1,), (1,), (2,), (None,)], "user_id long")
    assert rows(users.heavy_users(few, 2)) == [(1, 2)] and rows(users.heavy_users(few, 9)) == [(1, 2), (2, 1)]
    assert users.interaction_stats(few.limit(0)).first()["mean_per_user"] is None


def test_keywords_and_scores(spark, rows):
    items = [(1, ["CV ", None], ["seg"], ["gan", ""]), (2, None, None, None), (None, ["x"], None, None)]
    kw = keywords.field_keywords(spark.createDataFrame(items, "node_idx long, domain array<string>, task array<string>, method array<string>"))
    vocab = keywords.vocabulary(kw)
    assert rows(vocab) == [("cv", 1), ("gan", 2), ("seg", 3)]
    assert rows(keywords.weighted_bags(kw, vocab)) == [(1, 1, 2), (1, 2, 1), (1, 3, 1)]
    v = spark.createDataFrame([([1.0, 0.0], [0.75, 0.5]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(unit_score(cosine(F.col("a"), F.col("b")))).collect()] == [0.916025, 0.5]


def test_rankings_against_brute_force(spark):
    rng = random.Random(5)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)] + [(80, [0.0] * 4), (81, None)]
    df = spark.createDataFrame(vecs, "id long, vector array<double>")
    seen = spark.createDataFrame([(0, 5), (10, 6), (99, 7)], "query_id long, item_id long")
    got = {}
    for r in recommend.vector_topk(df, df.where("id % 10 = 0"), 3, seen=seen, block=3).collect():
        got.setdefault(r["query_id"], []).append((r["rk"], r["item_id"]))

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    hidden = {(0, 5), (10, 6)}
    for q, v in vecs:
        if q % 10 == 0:
            best = sorted((-round((cos(v, w) + 1) / 2, 9), i) for i, w in vecs if w and i != q and (q, i) not in hidden)[:3]
            assert [i for _, i in sorted(got[q])] == [i for _, i in best]


@pytest.mark.parametrize("ascending", [False, True])
def test_bag_ranking(spark, ascending):
    rng = random.Random(6)
    bags = {(i, rng.choice("abcdefgh")): rng.randrange(1, 4) for i in range(30) for _ in range(3)}
    profiles = {(q, rng.choice("abcdxyz")): 1 for q in range(7) for _ in range(2)}
    seen = {(q, rng.randrange(30)) for q in range(7) for _ in range(4)}
    got = recommend.bag_ranking(spark.createDataFrame([(q, k, float(w)) for (q, k), w in profiles.items()], "query_id long, keyword string, weight double"), spark.createDataFrame([(i, k, w) for (i, k), w in bags.items()], "item_id long, keyword string, weight long"), spark.createDataFrame(sorted(seen), "query_id long, item_id long"), 4, ascending, block=2)
    have = {}
    for r in got.collect():
        have.setdefault(r["query_id"], []).append((r["rk"], r["item_id"]))
        assert (r["query_id"], r["item_id"]) not in seen
    for q in {q for q, _ in profiles}:
        p = {k: w for (x, k), w in profiles.items() if x == q}
        scores = []
        for i in {i for i, _ in bags}:
            b = {k: w for (x, k), w in bags.items() if x == i}
            n = (sum(w * w for w in p.values()) * sum(w * w for w in b.values())) ** 0.5
            s = round((sum(p.get(k, 0) * w for k, w in b.items()) / n + 1) / 2, 9)
            if (q, i) not in seen:
                scores.append((s if ascending else -s, i))
        assert [i for _, i in sorted(have[q])] == [i for _, i in sorted(scores)[:4]]


def test_negatives(spark):
    pos = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 3), (2, 3), (None, 1), (3, None)], "user_id long, item_id long")
    got = [tuple(r) for r in recommend.negative_samples(pos).collect()]
    assert all(u == 2 and i != 3 for u, i, _ in got) and 1 <= len(got) <= 4 and len({i for _, i, _ in got}) == len(got)
    assert recommend.negative_samples(pos.limit(0)).count() == 0


def test_every_positive_gets_all_its_training_negatives(spark):
    have = {1: set(range(0, 400, 2)) | set(range(1, 380, 2)), 2: {3, 398}, 3: set(range(400)), 4: set(range(399))}
    pos = spark.createDataFrame([(u, 10 * i) for u, items in have.items() for i in items] + [(1, 0), (None, 10), (5, None)], "user_id long, item_id long")
    got = [tuple(r) for r in recommend.training_negatives(pos).collect()]
    counts = {}
    for u, of, i in got:
        assert of // 10 in have[u] and i % 10 == 0 and 0 <= i // 10 < 400 and i // 10 not in have[u]
        counts[u, of // 10] = counts.get((u, of // 10), 0) + 1
    assert counts == {(u, i): 4 for u in (1, 2, 4) for i in have[u]}
    assert {i // 10 for u, _, i in got if u == 1} == set(range(400)) - have[1]
    assert recommend.training_negatives(pos.limit(0)).count() == 0


def test_mf_recommend_trains_at_full_size(spark, monkeypatch):
    sizes, real = {}, models.factorise
    monkeypatch.setattr(core, "table", lambda *_: spark.createDataFrame([(u, i) for u in (0, 1, 2, 100) for i in range(6) if (u + i) % 3], "user_id long, item_id long"))
    monkeypatch.setattr(models, "factorise", lambda pairs, **size: sizes.update(size) or real(pairs, **size))
    got = core.mf_recommend(spark, "").collect()
    assert sizes == {"rank": 64, "iterations": 30} and sorted({r["user_id"] for r in got}) == [0, 100]


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, None, 9, 1]], "x long")
    assert [tuple(r) for r in numbering.dense_ids(df, ["x"], "n").orderBy("n").collect()] == [(None, 0), (1, 1), (3, 2), (5, 3), (9, 4)]
    assert numbering.dense_ids(df.limit(0), ["x"], "n").count() == 0


def test_parsing(spark, rows):
    bodies = ['{"top_k":[{"label_idx":2}]}', '{"candidates":[{"label_idx":"2"}]}', '{"top_k":[]}', "nonsense", None]
    got = parse.candidate_list(spark.createDataFrame([(b,) for b in bodies], "b string"), "b")
    assert [r["candidates"][0]["label_idx"] for r in got.collect()] == [2, 2]
    r = parse.keyword_object(spark.createDataFrame([('{"domain":["CV "]}',)], "b string"), "b").first()
    assert (r["domain"], r["task"], r["method"]) == (["CV "], [], [])
    works = ['{"ids":{"mag":"7"},"authorships":[{"author":{"display_name":"Ann"}},{"author":{"display_name":null}}]}', '{"ids":{},"authorships":[]}']
    assert rows(parse.works(spark.createDataFrame([(w,) for w in works], "b string"), "b")) == [("7", ["Ann"])]
    lists = spark.createDataFrame([("['a b', \"c's\"]",), ("[]",), (None,), ("oops",)], "t string")
    assert [r[0] for r in lists.select(parse.keyword_list(F.col("t"))).collect()] == [["a b", "c's"], [], [], []]


def test_providers(spark, rows):
    def flaky(text):
        if "quota" in text:
            raise RuntimeError("insufficient_quota")
        if "bad" in text:
            raise RuntimeError("no")
        return "{}", 3, 1

    asked = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "quota"), (4, ""), (5, None)], "node_idx long, text string")
    got = rows(providers.call_all(asked, flaky, providers.CallPolicy(tasks=2, attempts=2)), "node_idx", "status", "input_tokens")
    assert got == [(1, "success", 3), (2, "failed", 0), (3, "fatal", 0)]
    ids = spark.createDataFrame([(" 7",), ("8",), ("7",)], "paper_id string")
    client = lambda batch: [json.dumps({"ids": {"mag": i}, "authorships": [{"author": {"display_name": "A" + i}}]}) for i in batch if i == "7"]
    assert rows(providers.fetch_works(ids, client)) == [("7", ["A7"]), ("8", [])]


def test_files(spark, rows, tmp_path):
    import gzip

    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write("1,2\n3,4\n")
    assert rows(readers.edges_csv(spark, str(tmp_path / "e.csv.gz"))) == [(1, 2), (3, 4)]
    (tmp_path / "m.csv").write_text(" Node IDX,Paper ID\n1, 22\nx,3\n")
    assert rows(readers.id_map_csv(spark, str(tmp_path / "m.csv")))[:1] == [(1, "22")]
    (tmp_path / "p.tsv").write_text('7\tT one\t"An\nabstract"\n8\tT two\t\n')
    assert rows(readers.papers_tsv(spark, str(tmp_path / "p.tsv"))) == [("7", "T one", "An\nabstract"), ("8", "T two", None)]
    (tmp_path / "k.json").write_text('[{"node_idx":1,"features":["a"]},{"node_idx":2,"domain":["d"]}]')
    assert rows(readers.keyword_results(spark, str(tmp_path / "k.json")), "node_idx", "domain", "method") == [(1, [], ["a"]), (2, ["d"], [])]
    (tmp_path / "map.json").write_text('{"7":["x","y"]}')
    assert rows(readers.keyword_map_json(spark, str(tmp_path / "map.json"))) == [("7", ["x", "y"])]
    assert readers.optional(spark, str(tmp_path / "none.json"), readers.AUTHORS).count() == 0
    assert readers.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "m.csv")).endswith("m.csv")
    with pytest.raises(ValueError):
        readers.enough_rows(spark.range(3))
    df = spark.createDataFrame([(1, 2, "p", ["a", "b'c"])], "user_id long, item_id long, paper_id string, keywords array<string>")
    sinks.interactions_csv(df, str(tmp_path / "i"))
    assert readers.interactions_csv(spark, str(tmp_path / "i")).first()["keywords"] == '["a","b\'c"]'
    done = spark.createDataFrame([(1, "success", None), (2, "failed", "e")], "node_idx long, status string, error string")
    sinks.split_by_status(done, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_datasets_and_gather(spark, rows, tmp_path):
    import gzip

    for name, body in (("edge", "0,1\n"), ("node-feat", "0,0.5 1.5\n1,2 3\n"), ("node-label", "0,4\n1,5\n")):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(body)
    edges, features, labels = readers.graph_dataset(spark, str(tmp_path))
    assert rows(edges) == [(0, 1)] and rows(labels) == [(0, 4), (1, 5)] and rows(features) == [(0, [0.5, 1.5]), (1, [2.0, 3.0])]
    wanted = spark.createDataFrame([(1, 0), (0, 1), (1, 2), (9, 3)], "idx long, pos long")
    assert [(r["idx"], r["label_idx"]) for r in graph.gather(labels, wanted).collect()] == [(1, 5), (0, 4), (1, 5)]
    sinks.sample(labels.select("idx", F.array("label_idx").alias("label_idx")), str(tmp_path / "s"))
    assert rows(readers.node_sample(spark, str(tmp_path / "s"))) == [(0, 4), (1, 5)]
    calls = spark.createDataFrame([(1.0,), (3.0,), (None,)], "seconds double")
    assert tuple(cost.timing_summary(calls).first()) == (2, 4.0, 2.0) and cost.timing_summary(calls.limit(0)).first()["mean_seconds"] is None
    sinks.cost_report(cost.cost_summary(spark.createDataFrame([(1, 2)], "input_tokens long, output_tokens long"), 10), calls, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).count() == 1 and spark.read.json(str(tmp_path / "r/records")).count() == 3


def test_models(spark, tmp_path):
    from pyspark.ml.classification import FMClassificationModel

    from citeloom.operators import models

    rng = random.Random(1)
    pairs = [(u, i) for u in range(12) for i in range(20) if (i % 2 == u % 2) and rng.random() < 0.8]
    seen = spark.createDataFrame(pairs, "user_id long, item_id long")
    model, people, items = models.factorise(seen.withColumn("n", F.lit(1)), rank=4, iterations=5)
    got = models.recommend_factors(model, people, items, people.where("user_id < 2"), seen, 2).collect()
    assert {r["user_id"] for r in got} == {0, 1} and not {(r["user_id"], r["item_id"]) for r in got} & set(pairs)
    bags = spark.createDataFrame([(i, 1 + i % 2, 1) for i in range(20)], "item_id long, keyword_id long, weight long")
    data = seen.withColumn("label", F.lit(1.0)).unionAll(spark.createDataFrame([(u, i, 0.0) for u in range(12) for i in range(20) if i % 2 != u % 2], "user_id long, item_id long, label double"))
    features = models.content_features(data, people, bags, 12, 2)
    fm = models.content_model(features, factors=2, epochs=30)
    left, right = models.content_vectors(fm, people, bags, 12)
    from pyspark.ml.functions import vector_to_array

    raw = {(r["user_id"], r["item_id"]): r["p"] for r in fm.transform(features).select("user_id", "item_id", vector_to_array("rawPrediction")[1].alias("p")).collect()}
    l, r = {x["id"]: x["vector"] for x in left.collect()}, {x["id"]: x["vector"] for x in right.collect()}
    assert all(abs(sum(a * b for a, b in zip(l[u], r[i])) - p) < 1e-6 for (u, i), p in raw.items())
    assert models.loss_history(fm)
    models.save(fm, {"users": people}, str(tmp_path / "m"))
    again, ids = models.load(spark, FMClassificationModel, str(tmp_path / "m"), "users")
    assert again.factors == fm.factors and ids["users"].count() == 12 and models.loss_history(again) == []


def test_increments(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(source)
        enrich.run_incrementally(spark, source, "id long", out, state, lambda b: b)
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.collect()) == list(range(20)) and got.select("batch_id").distinct().count() == 2
    left = enrich.pending(spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (2,)], "k long"), "k")
    assert [r[0] for r in left.collect()] == [1]


def test_every_query_has_a_name_and_sql_names_are_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
