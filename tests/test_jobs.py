"""The composed jobs, prompts, reports, settings and readers on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom import config
from citeloom.functions import parse
from citeloom.operators import cost, graph, jobs, numbering, prompts
from citeloom.sources import providers, readers, sinks
from citeloom.streaming import enrich


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("CITELOOM_A_KEY", " from env ")
    assert config.setting(spark, "a.key") == "from env"
    spark.conf.set("spark.citeloom.a.key", "from conf")
    assert config.setting(spark, "a.key") == "from conf"
    spark.conf.set("spark.citeloom.a.key", "  ")
    assert config.setting(spark, "a.key") == "from env" and config.setting(spark, "no.key", "else") == "else" and config.setting(spark, "no.key") is None
    with pytest.raises(KeyError, match="CITELOOM_NO_KEY"):
        config.setting(spark, "no.key", required=True)
    spark.conf.unset("spark.citeloom.a.key")


@pytest.fixture
def answer():
    def call(text):
        if "quota" in text:
            raise RuntimeError("insufficient_quota")
        if "bad" in text:
            raise RuntimeError("no")
        return json.dumps({"domain": [text]}), 3, 1

    return call


def test_a_fatal_answer_ends_the_calls(spark, rows, answer):
    asked = spark.createDataFrame([(k, "quota" if k == 5 else "bad" if k == 2 else "fine") for k in range(50)], "node_idx long, text string")
    got = rows(providers.call_all(asked, answer, providers.CallPolicy(tasks=1, at_once=1, attempts=1)), "node_idx", "status")
    assert got == [(0, "success"), (1, "success"), (2, "failed"), (3, "success"), (4, "success"), (5, "fatal")]
    many = providers.call_all(asked.unionAll(asked.withColumn("node_idx", F.col("node_idx") + 1000)), answer, providers.CallPolicy(tasks=1, at_once=4, attempts=1))
    assert many.where("status = 'fatal'").count() >= 1 and many.where("node_idx >= 1000").count() < 50


def test_keyword_job(spark, rows, answer):
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, " \n"), (4, None), (5, "bad"), (6, "six"), (6, "six"), (None, "none"), (7, "x" * 100_000)], "node_idx long, text string").withColumn("status", F.lit("clash"))
    done = spark.createDataFrame([(2,), (2,), (None,)], "node_idx long")
    job = jobs.keyword_job(texts, done, answer, providers.CallPolicy(attempts=1), project_size=10)
    assert rows(job.results, "node_idx", "domain") == sorted([(1, ["one"]), (6, ["six"]), (7, ["x" * 100_000])], key=repr)
    assert rows(job.errors) == [(5, "no", "failed")] and rows(job.missing) == [(3,), (4,)]
    summary = job.costs.first()
    assert (summary["calls"], summary["total_tokens"], summary["projected_input_tokens"]) == (3, 12, 30.0)
    assert len(rows(jobs.by_status(job))) == 6
    trial = jobs.keyword_job(texts, done, answer, providers.CallPolicy(attempts=1), limit=2)
    assert rows(trial.results, "node_idx") == [(1,)] and rows(trial.missing) == [(3,)]
    none = jobs.keyword_job(texts.limit(0), done, answer)
    assert none.results.count() == none.errors.count() == none.missing.count() == 0 and none.costs.first()["calls"] == 0


def test_progress_ids_and_usage(spark, rows, answer):
    answers, watch = providers.observed(providers.call_all(spark.createDataFrame([(1, "a"), (2, "bad")], "node_idx long, text string"), answer, providers.CallPolicy(attempts=1)))
    answers.collect()
    assert watch.get == {"calls": 2, "succeeded": 1, "tokens": 4}
    ids = spark.createDataFrame([(" 3",), ("1",), ("2",), ("2 ",), ("",), (None,)], "paper_id string")
    assert rows(providers.joined_ids(ids, 2)) == [(0, "1|2"), (1, "3")] and providers.joined_ids(ids.limit(0)).count() == 0
    bodies = ['{"usage":{"prompt_tokens":5,"completion_tokens":"7"}}', '{"usage":{}}', "{}", "junk", None]
    got = parse.usage(spark.createDataFrame([(b,) for b in bodies], "body string"), "body")
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 0)] * 4 + [(5, 7)]


def test_works_client(spark, rows):
    def opener():
        import io
        from urllib.parse import parse_qs, urlparse

        class Answer(io.BytesIO):
            status = 200

        def open_url(url, timeout):
            asked = parse_qs(urlparse(url).query)
            assert timeout == 3 and asked["select"] == ["ids,authorships"]
            ids = asked["filter"][0].removeprefix("ids.mag:").split("|")
            if "9" in ids:
                raise TimeoutError
            answer = Answer(json.dumps({"results": [{"ids": {"mag": i}, "authorships": [{"author": {"display_name": "A" + i}}]} for i in ids]}).encode())
            answer.status = 500 if "8" in ids else 200
            return answer

        return open_url

    ids = spark.createDataFrame([(str(k),) for k in range(10)], "paper_id string").coalesce(1)
    got = dict(rows(providers.fetch_works(ids, providers.works_client("http://localhost/works", opener(), 3), batch=1)))
    assert got == {str(k): [f"A{k}"] if k < 8 else [] for k in range(10)}


def test_reports_and_sizes(spark, rows):
    calls = spark.createDataFrame([(1_234_567, 20)], "input_tokens long, output_tokens long")
    lines = [r["line"] for r in cost.report_lines(cost.cost_summary(calls, 1000)).orderBy("line_no").collect()]
    assert lines[1] == "02 Input tokens: 1,234,567" and lines[6] == "07 Projected input cost: $185.1851" and lines[9] == "10 Share of input in cost: 99.99%"
    assert len(cost.report_lines(cost.cost_summary(calls.limit(0), 10)).collect()) == 10
    ids = spark.createDataFrame([(3, None), (None, None)], "a long, b long")
    assert rows(numbering.cardinalities(ids, "a", "b")) == [("a", 4), ("b", 0)]


def test_prompts(spark, rows):
    asked = spark.createDataFrame([(1, "Graph  neural nets"), (2, "unheard of"), (3, " "), (4, None), (None, "graph")], "prompt_id long, text string")
    words = prompts.prompt_keywords(asked)
    assert rows(words.where("prompt_id = 1"), "keyword") == sorted([(w,) for w in ("graph", "neural", "nets", "graph neural", "neural nets", "graph neural nets")], key=repr)
    assert {r["prompt_id"] for r in words.collect()} == {1, 2}
    bags = spark.createDataFrame([(10, "graph", 1), (10, "neural nets", 1), (11, "graph", 2), (12, "cv", 1)], "item_id long, keyword string, weight long")
    got = rows(prompts.rank_prompts(words, bags, 2))
    assert got == [(1, 1, 10, 1.0), (1, 2, 11, 0.853553), (2, 1, 10, 0.5), (2, 2, 11, 0.5)]
    assert prompts.rank_prompts(words.limit(0), bags).count() == 0
    ranking = spark.createDataFrame([(1, 1, 10, 0.6125), (1, 2, 12, 0.5)], "q long, rk long, item_id long, score double")
    titles, authors = spark.createDataFrame([(10, "T")], "item_id long, title string"), spark.createDataFrame([(12, "Ann")], "item_id long, authors_str string")
    shown = prompts.decorated(ranking, "q", titles, authors, words.withColumnRenamed("prompt_id", "q"), bags.select("item_id", "keyword"))
    assert rows(shown) == [(1, 1, 10, 0.6125, "61.3%", "T", "Unknown Authors", "graph, neural nets"), (1, 2, 12, 0.5, "50.0%", "Title Not Found", "Ann", "")]


def test_readers_and_sinks(spark, rows, tmp_path):
    (tmp_path / "one.csv").write_text("1\n2\n")
    with pytest.raises(ValueError):
        readers.edges_csv(spark, str(tmp_path / "one.csv"))
    assert readers.node_count(spark.createDataFrame([(1, 7), (2, 3)], "src long, dst long")) == 8 and readers.node_count(spark.createDataFrame([], "src long, dst long")) == 0
    df = spark.createDataFrame([(1, "Ann", ["a"], 2), (2, None, None, 0)], "user_id long, author_name string, top_keywords array<string>, total_papers long")
    sinks.json_lines(df, str(tmp_path / "lines"))
    assert rows(readers.json_array(spark, str(tmp_path / "lines"), readers.PROFILES)) == rows(df)
    maps = spark.createDataFrame([("7", ["x"]), ("8", [])], "paper_id string, keywords array<string>")
    sinks.keyword_map(maps, str(tmp_path / "maps"))
    assert rows(readers.keyword_map_json(spark, str(tmp_path / "maps"))) == rows(maps)
    (tmp_path / "pretty.json").write_text('{\n "7": ["x"],\n "8": []\n}\n')
    assert rows(readers.keyword_map_json(spark, str(tmp_path / "pretty.json"))) == rows(maps)
    (tmp_path / "p.tsv").write_text("7\tT\tA\n")
    assert rows(readers.papers_tsv(spark, str(tmp_path / "p.tsv"), one_line=True)) == [("7", "T", "A")]
    (tmp_path / "c.csv").write_text("label idx,arxiv category\n0,cs.AI\n1,cs.CL\n")
    assert rows(readers.categories_csv(spark, str(tmp_path / "c.csv"))) == [(0, "cs.AI"), (1, "cs.CL")]
    assert sinks.stamped("/a/b/", "r1") == "/a/b/run_id=r1"


def test_state_outlives_a_session(spark, tmp_path):
    spark.conf.set("spark.citeloom.state.dir", str(tmp_path / "home"))
    home = enrich.state_folder(spark, "job")
    assert home == f"{tmp_path}/home/jobs/job"
    source = str(tmp_path / "in")
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).write.mode("append").parquet(source)
        other = spark.newSession()
        enrich.run_incrementally(other, source, "id long", f"{home}/out", f"{home}/state", lambda b: b)
    got = spark.read.parquet(f"{home}/out").groupBy("batch_id").count().collect()
    assert sorted((r["batch_id"], r["count"]) for r in got) == [(0, 5), (1, 5)]
    spark.conf.unset("spark.citeloom.state.dir")


def test_forest_fire_of_scattered_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(500)], "idx long")
    got = graph.forest_fire(nodes, spark.createDataFrame([(1, 2)], "src long, dst long"), 300).collect()
    assert len(got) == len({r["idx"] for r in got}) == 300
