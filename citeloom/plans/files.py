"""Queries that write the project's tables in the file formats of the pipeline and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import parse
from citeloom.functions import text as T
from citeloom.operators import cost, graph
from citeloom.plans import core
from citeloom.plans.core_sql import _NEAR, _PAPERS, _cost, _edges
from citeloom.session import shared_folder
from citeloom.sources import providers, readers, sinks
from citeloom.sources.catalog import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _place(spark: SparkSession, name: str) -> str:
    """A path of its own for a run, in the shared folder."""
    return sinks.stamped(f"{shared_folder(spark)}/files/{name}", uuid.uuid4().hex)


@query
def interactions_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "interactions")
    rows = table(spark, d, "final_user_interactions", "user_id", "item_id", "paper_id", "keywords").withColumn("keywords", parse.keyword_list(F.col("keywords")))
    sinks.interactions_csv(rows, path)
    back = readers.interactions_csv(spark, path).withColumn("n_keywords", F.size(F.from_json("keywords", "array<string>")).cast("long"))
    return back.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_keywords").alias("n_keywords"))


@query
def profiles_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "profiles")
    sinks.json_lines(table(spark, d, "final_user_profiles", "user_id", "author_name", "top_keywords", "total_papers"), path)
    back = readers.optional(spark, path, readers.PROFILES)
    return back.select("user_id", "author_name", F.coalesce(F.size("top_keywords"), F.lit(-1)).cast("long").alias("n_keywords"), "total_papers")


@query
def author_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "authors")
    sinks.json_lines(table(spark, d, "author_data_openalex", "node_idx", "paper_id", "authors"), path)
    return readers.json_array(spark, path, readers.AUTHORS).select("node_idx", "paper_id", F.explode("authors").alias("author"))


@query
def keyword_results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "keywords")
    sinks.json_lines(table(spark, d, "llm_extraction_results", "node_idx", "domain", "task", "method", "input_tokens", "output_tokens", "status"), path)
    back = readers.keyword_results(spark, readers.first_existing(spark, f"{path}/none", path))
    return back.select("node_idx", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("domain", "task", "method")], "input_tokens", "status")


@query
def keyword_map_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "map")
    top = core.tfidf_paper_keywords(spark, d).groupBy(F.col("paper").cast("string").alias("paper_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "term"))), lambda x: x["term"]).alias("keywords"))
    sinks.keyword_map(top, path)
    return readers.keyword_map_json(spark, path).select(F.col("paper_id").cast("long").alias("paper"), F.posexplode("keywords").alias("pos", "term")).select("paper", (F.col("pos") + 1).cast("long").alias("rk"), "term")


@query
def papers_tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "titleabs")
    rows = table(spark, d, "titleabs", "paper_id", "title", "abstract").where("paper_id is not null")
    rows.write.option("sep", "\t").option("escape", '"').option("quoteAll", True).option("nullValue", "\\N").csv(path)
    back = readers.enough_rows(readers.papers_tsv(spark, path))
    clean = lambda c: F.when(F.col(c) != "\\N", F.col(c))
    return back.select(F.trim("paper_id").alias("paper_id"), F.coalesce(F.length(clean("title")), F.lit(0)).cast("long").alias("n_title"), F.coalesce(F.length(clean("abstract")), F.lit(0)).cast("long").alias("n_abstract"))


@query
def graph_files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark folder of gzipped edges, features and labels: per label the nodes, their features' sum and their edges."""
    path = _place(spark, "graph")
    core._edges(spark, d).write.option("compression", "gzip").csv(f"{path}/edge.csv.gz")
    vectors = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    vectors.select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).write.option("compression", "gzip").csv(f"{path}/node-feat.csv.gz")
    vectors.select("vec_id", "label").write.option("compression", "gzip").csv(f"{path}/node-label.csv.gz")
    edges, features, labels = readers.graph_dataset(spark, path)
    degree = edges.groupBy(F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    nodes = features.join(labels, "idx").join(degree, "idx", "left")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return nodes.groupBy("label_idx").agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.sum(total), 3).alias("feature_sum"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"))


@query
def node_map_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "map-csv")
    table(spark, d, "nodeidx2paperid", "node_idx", "paper_id").toDF(" Node IDX", "Paper ID").write.option("header", True).csv(path)
    return readers.id_map_csv(spark, path).select("idx", F.trim("paper_id").alias("paper_id"))


@query
def categories_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "categories")
    table(spark, d, "labelidx2category", "label_idx", "category").toDF("label idx", "arxiv category").write.option("header", True).option("compression", "gzip").csv(path)
    return readers.categories_csv(spark, path)


@query
def sample_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A saved sample, labels in lists of one, and of it the rows of the ids divisible by 100, in their order."""
    path = _place(spark, "sample")
    sinks.sample(table(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("features"), F.array("label").alias("label_idx")), path)
    back = readers.node_sample(spark, path)
    wanted = back.where("idx % 100 = 0").select("idx", (-F.col("idx")).alias("pos"))
    return graph.gather(back, wanted).select("idx", "pos", "label_idx", F.round(F.element_at("features", 1).cast("double"), 5).alias("first_feature"))


@query
def status_files(spark: SparkSession, d: str) -> DataFrame:
    """The job's answers, split into two folders by status and read again."""
    path = _place(spark, "answers")
    job = core._job(spark, d, policy=providers.CallPolicy(attempts=1))
    answers = job.results.select("node_idx", "status", F.lit(None).cast("string").alias("error")).unionByName(job.errors)
    sinks.split_by_status(answers, f"{path}/good", f"{path}/bad")
    return spark.read.parquet(f"{path}/good").select("node_idx", "status").unionAll(spark.read.parquet(f"{path}/bad").select("node_idx", "status"))


@query
def cost_files(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "costs")
    calls = table(spark, d, "llm_extraction_results", "input_tokens", "output_tokens", "status").where("status = 'success'")
    sinks.cost_report(cost.cost_summary(calls, 16000), calls, path)
    n = spark.read.json(f"{path}/records").agg(F.count(F.lit(1)).alias("n_records"))
    return spark.read.json(f"{path}/summary").select("calls", "total_tokens", "projected_cost").join(F.broadcast(n))


@query
def call_timing(spark: SparkSession, d: str) -> DataFrame:
    """A call is taken to last a hundredth of a second for each token of its answer."""
    return cost.timing_summary(table(spark, d, "llm_extraction_results", "output_tokens").select((F.col("output_tokens") / 100).alias("seconds")))


@query
def fetched_works(spark: SparkSession, d: str) -> DataFrame:
    """Authors of the papers by a stand-in for the bibliographic service, which knows the ids that end in an even digit."""

    def client(ids: list[str]) -> list[str]:
        return ['{"ids":{"mag":"%s"},"authorships":[{"author":{"display_name":"Author %s"}},{"author":{"display_name":null}}]}' % (i, i) for i in ids if i[-1:] in "02468"]

    found = providers.fetch_works(table(spark, d, "nodeidx2paperid", "paper_id"), client)
    return found.select("paper_id", F.array_join("authors", ", ").alias("authors"))


@query
def prompt_word_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "topic_prediction_results", "title").select(F.explode(T.prompt_words(F.col("title"))).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def request_texts(spark: SparkSession, d: str) -> DataFrame:
    """The requests for keywords of papers and of prompts, as digests."""
    rows = core._papers(spark, d)
    return rows.select("paper", F.md5(T.keyword_prompt(F.col("title"), F.col("abstract"))).alias("paper_request"), F.md5(T.chat_prompt(F.col("title"))).alias("chat_request"))


@query
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    """The citation context of every part as a line of text, brands standing for categories."""
    parts = core._parts(spark, d)
    edges, labels = core._edges(spark, d, "R"), core._part_labels(spark, d)
    brands = labels.join(table(spark, d, "part", F.col("p_partkey").alias("idx"), "p_brand"), "idx").groupBy("label_idx").agg(F.min("p_brand").alias("category"))
    return graph.context_text(graph.citation_context(parts, parts, edges, labels), graph.label_distribution(graph.neighbours(edges, 50), labels), brands)


_KEYWORD_HEAD = T.KEYWORD_REQUEST.replace("'", "''")
_CHAT_HEAD = T.CHAT_REQUEST.replace("'", "''")
_E = core.SQL

SQL = {
    "interactions_csv_round_trip": """SELECT user_id, item_id, count(*) AS n, CAST(sum(len(regexp_extract_all(coalesce(keywords, ''), '''([^'']*)''|"([^"]*)"'))) AS BIGINT) AS n_keywords FROM final_user_interactions GROUP BY ALL""",
    "profiles_json_round_trip": "SELECT user_id, author_name, coalesce(len(top_keywords), -1) AS n_keywords, total_papers FROM final_user_profiles",
    "author_json_round_trip": "SELECT node_idx, paper_id, unnest(authors) AS author FROM author_data_openalex",
    "keyword_results_round_trip": "SELECT node_idx, coalesce(len(domain), 0) AS n_domain, coalesce(len(task), 0) AS n_task, coalesce(len(method), 0) AS n_method, input_tokens, status FROM llm_extraction_results",
    "keyword_map_round_trip": f"SELECT paper, rk, term FROM ({_E['tfidf_paper_keywords']})",
    "papers_tsv_round_trip": "SELECT trim(paper_id, ' ') AS paper_id, coalesce(length(title), 0) AS n_title, coalesce(length(abstract), 0) AS n_abstract FROM titleabs WHERE paper_id IS NOT NULL",
    "graph_files_round_trip": f"""WITH {_edges()}, g AS (SELECT src, CAST(sum(multiplicity) AS BIGINT) AS n FROM e GROUP BY src)
        SELECT label AS label_idx, count(*) AS n_nodes, round(sum(list_sum(embedding::DOUBLE[])), 3) AS feature_sum, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_edges FROM embeddings LEFT JOIN g ON g.src = vec_id GROUP BY label""",
    "node_map_round_trip": "SELECT node_idx AS idx, trim(paper_id, ' ') AS paper_id FROM nodeidx2paperid",
    "categories_round_trip": "SELECT label_idx, category FROM labelidx2category",
    "sample_round_trip": "SELECT vec_id AS idx, -vec_id AS pos, label AS label_idx, round(embedding[1]::DOUBLE, 5) AS first_feature FROM embeddings WHERE vec_id % 100 = 0",
    "status_files": f"SELECT node_idx, status FROM ({_E['enrichment_job']}) WHERE status <> 'missing'",
    "cost_files": f"""WITH {_cost("llm_extraction_results WHERE status = 'success'")} SELECT calls, total_tokens, projected_cost, calls AS n_records FROM cs""",
    "call_timing": "SELECT count(output_tokens) AS calls, coalesce(sum(output_tokens / 100), 0) AS total_seconds, avg(output_tokens / 100) AS mean_seconds FROM llm_extraction_results",
    "fetched_works": "SELECT paper_id, CASE WHEN right(paper_id, 1) IN ('0', '2', '4', '6', '8') THEN 'Author ' || paper_id ELSE '' END AS authors FROM (SELECT DISTINCT trim(paper_id, ' ') AS paper_id FROM nodeidx2paperid) WHERE paper_id <> ''",
    "prompt_word_counts": r"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(title, '\s+')) AS w FROM topic_prediction_results) WHERE regexp_full_match(w, '\p{L}+') GROUP BY 1",
    "request_texts": f"WITH {_PAPERS} SELECT paper, md5('{_KEYWORD_HEAD}' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '')) AS paper_request, md5('{_CHAT_HEAD}' || chr(10) || coalesce(title, '')) AS chat_request FROM papers",
    "context_lines": f"""WITH {_edges("l_returnflag = 'R'")}, {_NEAR}, br AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS label_idx FROM (SELECT DISTINCT p_brand FROM part)),
        ev AS (SELECT idx, string_agg(p_brand || ' (count=' || cnt || ', ratio=' || printf('%.2f', round(round(cnt / total, 6), 2)) || ')', '; ' ORDER BY rk) AS text FROM dist JOIN br USING (label_idx) WHERE rk <= 5 GROUP BY idx)
        SELECT p_partkey AS idx, coalesce(text, CASE WHEN p_partkey IN (SELECT idx FROM near) THEN 'unlabeled' ELSE 'isolated' END) AS text FROM part LEFT JOIN ev ON ev.idx = p_partkey""",
}
